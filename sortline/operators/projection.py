"""From source rows to tasks: project, check, upsert, and the job that consumes rows by their status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V

#: Task columns that a projection may change later.
MUTABLE = ("wave_code", "wave_remark", "working_area", "order_id", "store_id", "store_name", "product_code", "pick_location", "updated_time")
#: Longest texts that a task takes (fixed values).
LENGTHS = {"barcode": 128, "wave_code": 64, "wave_remark": 128, "working_area": 32, "order_id": 64, "store_id": 64, "store_name": 300, "product_code": 64, "pick_location": 64}
TEXTS = ("barcode", "wave_code", "wave_remark", "working_area", "order_id", "store_id", "store_name", "product_code", "pick_location")


@dataclass(frozen=True)
class Projection:
    """Which source columns hold what. Texts that aren't named stay null."""

    source_table: str
    source_type: int
    key: str
    created: str
    texts: dict[str, str]
    key_length: int = 64


def project(rows: DataFrame, p: Projection, now) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejects). Rows with a blank key are skipped: they are in neither. Rejects have business_key and reason: an unknown source type, too
    long a key or text, or no creation time."""
    key, created = C.blank_to_null(F.col(p.key).cast("string")), F.col(p.created).try_cast("timestamp_ntz")
    texts = [(C.blank_to_null(F.col(p.texts[t]).cast("string")) if t in p.texts else F.lit(None).cast("string")).alias(t) for t in TEXTS]
    made = rows.select(
        "*",
        F.struct(
            F.lit(p.source_table).alias("source_table_code"),
            F.lit(p.source_type).alias("source_type"),
            key.alias("business_key"),
            created.alias("created_time"),
            C.ntz(now).alias("updated_time"),
            *texts,
        ).alias("made"),
    ).select("made.*")
    made = made.filter(F.col("business_key").isNotNull())
    reason = (
        F.when(F.lit(p.source_type not in (V.SPLIT, V.FULL_CASE)), "unknown source type")
        .when(F.length("business_key") > p.key_length, "key too long")
        .when(F.col("created_time").isNull(), "no creation time")
    )
    for name in p.texts:
        reason = reason.when(F.length(name) > LENGTHS[name], f"{name} too long")
    judged = made.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).select("business_key", "reason")


def last_of_batch(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with one key the last by `order`."""
    return C.first_of(rows, list(keys), F.desc(order))


def upsert(tasks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tasks after a projection, each with change (I, U or null). Tasks that are there get the mutable columns alone, and the barcode only while they are created,
    unscanned and without one. New ones start as created."""
    keys = ["source_table_code", "business_key"]
    # flat columns and a mark for each side, not structs: of a struct whose presence is asked all columns would be moved
    old = tasks.select(*keys, F.lit(True).alias("is_old"), *(F.col(c).alias(f"old_{c}") for c in tasks.columns if c not in keys))
    new = incoming.select(*keys, F.lit(True).alias("is_new"), *(F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in keys))
    was, comes = F.col("is_old").isNotNull(), F.col("is_new").isNotNull()
    fields = [c for c in tasks.columns if c not in keys]
    kinds = {f.name: f.dataType for f in tasks.schema}
    take_barcode = (F.col("old_status") == V.CREATED) & F.col("old_scanned_at").isNull() & C.blank_to_null("old_barcode").isNull()
    given = set(incoming.columns)
    start = {"status": F.lit(V.CREATED), "feedback_status": F.lit(V.NOT_REQUIRED), "is_exception": F.lit(False), "is_recirculated": F.lit(False), "scan_retry_count": F.lit(0), "resolved_dock_code": F.lit(V.NO_DOCK)}

    def value(c: str) -> Column:
        fresh = F.col(f"new_{c}") if c in given else start.get(c, F.lit(None))
        if c in MUTABLE and c in given:
            kept = F.when(comes, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
        elif c == "barcode" and c in given:
            kept = F.when(take_barcode & comes, F.col("new_barcode")).otherwise(F.col("old_barcode"))
        else:
            kept = F.col(f"old_{c}")
        return F.when(was, kept).otherwise(fresh).cast(kinds[c]).alias(c)

    change = F.when(~was, "I").when(comes, "U")
    out = old.join(new, keys, "full").select(*keys, *map(value, fields), change.alias("change"))
    derived = {"normalized_wave_code": C.normalized_wave(), "normalized_barcode": C.blank_to_null("barcode"), "shard_month": F.coalesce("shard_month", C.month_key("created_time"))}
    return out.withColumns({c: e for c, e in derived.items() if c in tasks.columns})


def upsert_months(tasks: DataFrame, incoming: DataFrame) -> tuple[list[str], DataFrame]:
    """(months, their tasks after a projection, as upsert() gives them), to be written in place of those months. Tasks stay in their month; new ones go to that of their creation."""
    keys = ["source_table_code", "business_key"]
    held = tasks.select(*keys, "shard_month").join(incoming.select(*keys).distinct(), keys, "left_semi").select("shard_month")
    months = sorted(r[0] for r in held.unionByName(incoming.select(C.month_key("created_time").alias("shard_month"))).distinct().collect())  # a table has few
    return months, upsert(tasks.filter(F.col("shard_month").isin(months)), incoming)


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """Inserts and updates apart, and their sum."""
    inserted, updated = (F.count_if(F.col("change") == x).cast("long") for x in "IU")
    return upserted.agg(inserted.alias("inserted"), updated.alias("updated"), (inserted + updated).alias("affected"))


def refresh(tasks: DataFrame) -> DataFrame:
    """Derived columns anew."""
    return tasks.withColumns({"normalized_barcode": C.blank_to_null("barcode"), "normalized_wave_code": C.normalized_wave(), "resolved_dock_code": C.resolved_dock()})


@dataclass(frozen=True)
class Consumed:
    tasks: DataFrame
    write_back: DataFrame
    counts: DataFrame


def consume(pending: DataFrame, tasks: DataFrame, p: Projection, row_id: str, order: str, done: str, batch_id: str, now, write_back: bool = True) -> Consumed:
    """Project pending rows into tasks and mark them in the source. counts: read, appended, skipped (no key), without_id (can't be marked), and moves_cursor: whether
    the cursor may move on, which needs every row marked unless write-back is off."""
    from ..sources.sinks import status_write_back

    good, _ = project(last_of_batch(pending.filter(C.blank_to_null(F.col(p.key).cast("string")).isNotNull()), (p.key,), order), p, now)
    out = upsert(tasks, good)
    has_key, has_id = C.blank_to_null(F.col(p.key).cast("string")).isNotNull(), C.blank_to_null(F.col(row_id).cast("string")).isNotNull()
    back = status_write_back(pending.filter(has_key), row_id, done, now, batch_id)
    count = lambda c: F.count_if(c).cast("long")
    counts = pending.agg(F.count("*").cast("long").alias("read"), count(has_key).alias("appended"), count(~has_key).alias("skipped"), count(has_key & ~has_id).alias("without_id"))
    counts = counts.withColumn("moves_cursor", F.lit(not write_back) | ((F.col("skipped") == 0) & (F.col("without_id") == 0)))
    return Consumed(out, back if write_back else back.limit(0), counts)
