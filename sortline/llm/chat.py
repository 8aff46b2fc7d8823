"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue is rendered as the assistant, with all others as named users, and a mask that trains on the turns of that participant alone.
A dialogue is rendered whole. One that is too long for a row (by bytes, or turns) is dealt into parts by its turn numbers, and these into pieces; every participant gets all of them, each
with the length of what comes before it, so that they make up the whole again. No task holds such a dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Roles that speak in every rendering as themselves.
NARRATORS = ("system",)
#: A dialogue of more turns or bytes than these is dealt into parts of so many turn numbers, and a part of more turns or bytes into pieces.
PART_TURNS = 512
MOST_TURNS, MOST_BYTES = 65_536, 16 << 20
#: Long dialogues, their turn numbers and their participants are broadcast up to so many; more are joined by shuffle, turn numbers in slices, so that a hot number's turns are in no task alone.
BROADCAST_PIECES = 100_000
SLICES = 32
#: Bytes that a turn adds to its role and text, about.
MARKS = 64

ASSISTANT, END = "<|assistant|>", "<|end|>\n"


def escaped(c: Column) -> Column:
    """Text in which no marker can begin: the backslashes between "<" and "|" become one more, from none to one. To read it back, take one away."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def _name(c: Column) -> Column:
    """A role inside of a marker: it can't end that either."""
    return F.regexp_replace(escaped(c), r"\|(\\*)>", r"|\\$1>")


def _pieces(sizes: DataFrame, part_turns: int, most_turns: int, most_bytes: int) -> DataFrame:
    """For every dialogue, part and turn number of parts that are too long: first (the piece that its turns begin in) and pieces (that they are dealt into). sizes: turns n and bytes of each
    turn number."""
    in_part = Window.partitionBy("conv_id", "part")  # of part_turns numbers at most
    before = lambda c: F.sum(c).over(in_part.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    counts = sizes.withColumns({"all": F.sum("n").over(in_part), "all_bytes": F.sum("bytes").over(in_part), "n_before": before("n"), "bytes_before": before("bytes")})
    pieces = F.greatest(F.when(F.col("n") > most_turns, F.ceil(F.col("n") / part_turns)).otherwise(1), F.ceil(F.col("bytes") / most_bytes))
    return counts.filter((F.col("all") > most_turns) | (F.col("all_bytes") > most_bytes)).select(
        F.col("conv_id").alias("of"),
        F.col("part").alias("of_part"),
        F.col("turn").alias("of_turn"),
        (F.floor(F.col("n_before") / part_turns) + F.floor(F.col("bytes_before") / most_bytes)).alias("first"),
        pieces.alias("pieces"),
    )


def _placed(dealt: DataFrame, pieces: DataFrame) -> DataFrame:
    """dealt with piece."""
    n = pieces.count()
    if not n:
        return dealt.withColumn("piece", F.lit(0).cast("long"))
    known = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & F.col("turn").eqNullSafe(F.col("of_turn"))
    dealt = dealt.withColumn("spot", F.conv(F.substring(F.md5(F.concat_ws("|", "role", "said", "lot")), 1, 8), 16, 10).cast("long"))
    if n <= BROADCAST_PIECES:
        both = dealt.join(F.broadcast(pieces), known, "left")
    else:
        both = dealt.join(pieces.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), known & (F.pmod("spot", F.lit(SLICES)) == F.col("slice")), "left")
    return both.withColumn("piece", F.coalesce(F.col("first") + F.pmod("spot", F.col("pieces")), F.lit(0)).cast("long"))


def _few(df: DataFrame) -> DataFrame:
    """To be broadcast, if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_PIECES else df


def rotate(
    turns: DataFrame,
    narrators: tuple[str, ...] = NARRATORS,
    part_turns: int = PART_TURNS,
    most_turns: int = MOST_TURNS,
    most_bytes: int = MOST_BYTES,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row for each dialogue and participant: conv_id, speaker, part, piece, before, n_turns, text, mask, n_trained.

    text: each turn as "<|assistant|>", "<|user name=...|>" or "<|narrator|>", its text and "<|end|>". In texts and roles markers are escaped (see escaped()), so
    none can be forged. mask: run lengths in characters with 0 (no loss) or 1 (loss), as "12:0,40:1"; loss falls on the speaker's own texts and the end marks after
    them. n_trained: characters with loss.

    Turns stand by number (none first), then role and text. A dialogue of at most `most_turns` turns and about `most_bytes` bytes is one row, part 0 and piece 0. A longer one has a row for each part of
    `part_turns` turn numbers (turns without a number are part -1), and for each piece of parts that are too long again; those of one number are dealt into pieces by their
    hash. Every participant has all rows, also where nothing is theirs, and `before` tells the characters of those before. Null roles speak as "unknown", null texts are
    empty. A null conv_id is a dialogue of its own. Repeated rows are repeated turns. Dialogues of narrators alone give no rows. Other columns are ignored.
    """
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"),
    )
    size = F.octet_length("role") + F.octet_length("said") + MARKS
    sizes = materialize(said.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "sizes")
    long_ones = sizes.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter((F.col("n") > most_turns) | (F.col("bytes") > most_bytes))
    long_ones = materialize(long_ones.select(F.col("conv_id").alias("long"), F.lit(True).alias("is_long")), "long")
    copies = F.array_repeat(F.struct("turn", "role", "said"), F.col("times"))
    listed = F.array_sort(F.flatten(F.collect_list(copies))).alias("turns")
    # turns that are the same are counted first, so that copies of one stand in no task alone
    same = said.groupBy("conv_id", "turn", "role", "said").agg(F.count("*").alias("n"))
    if long_ones.isEmpty():
        whole = same.withColumn("times", F.col("n").cast("int")).groupBy("conv_id").agg(listed)
        return _rendered(_whole(whole, narrators), narrators)
    known = F.col("conv_id").eqNullSafe(F.col("long"))
    marked = same.join(_few(long_ones), known, "left")
    whole = marked.filter(F.col("is_long").isNull()).withColumn("times", F.col("n").cast("int")).groupBy("conv_id").agg(listed)
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    of_long = sizes.join(_few(long_ones), known, "left_semi").withColumn("part", part)
    pieces = materialize(_pieces(of_long, part_turns, most_turns, most_bytes), "pieces")
    # and then dealt out in equal lots
    lots = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / part_turns).cast("int"))
    dealt = marked.filter("is_long").select("conv_id", "turn", part.alias("part"), "role", "said", "n", F.explode(lots).alias("lot"))
    dealt = dealt.withColumn("times", F.least(F.lit(part_turns), F.col("n") - F.col("lot") * part_turns).cast("int"))
    parts = materialize(_placed(dealt, pieces).groupBy("conv_id", "part", "piece").agg(listed), "parts")
    speakers = parts.select("conv_id", F.explode(F.array_distinct(F.transform("turns", lambda x: x.role))).alias("speaker")).filter(~F.col("speaker").isin(*narrators)).distinct()
    speakers = materialize(speakers.select(F.col("conv_id").alias("spoke_in"), "speaker"), "speakers")
    every = parts.join(_few(speakers), F.col("conv_id").eqNullSafe(F.col("spoke_in"))).drop("spoke_in")
    # lengths alone are summed up in the order of the parts; the turns stay where they are
    key = ("conv_id", "speaker", "part", "piece")
    lengths = every.select(*key, F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + F.length(_head(x, narrators)) + F.length(_rest(x))).alias("chars"))
    upto = Window.partitionBy("conv_id", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lengths.withColumn("before", F.sum("chars").over(upto) - F.col("chars")).select(*(F.col(c).alias(f"b_{c}") for c in key), "before")
    on = F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("speaker") == F.col("b_speaker")) & (F.col("part") == F.col("b_part")) & (F.col("piece") == F.col("b_piece"))
    return _rendered(_whole(whole, narrators).unionByName(every.join(before, on).select(*key, "before", "turns")), narrators)


def _whole(dialogues: DataFrame, narrators: tuple[str, ...]) -> DataFrame:
    """A row for each participant of dialogues that are rendered whole."""
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda x: x.role), lambda r: ~r.isin(*narrators)))
    zero = F.lit(0).cast("long")
    return dialogues.select("conv_id", F.explode(speakers).alias("speaker"), zero.alias("part"), zero.alias("piece"), zero.alias("before"), "turns")


def _head(x: Column, narrators: tuple[str, ...]) -> Column:
    named = F.concat(F.lit("<|user name="), _name(x.role), F.lit("|>"))
    return F.when(x.role == F.col("speaker"), F.lit(ASSISTANT)).when(x.role.isin(*narrators), F.concat(F.lit("<|"), _name(x.role), F.lit("|>"))).otherwise(named)


def _rest(x: Column) -> Column:
    return F.concat(escaped(x.said), F.lit(END))


def _rendered(rows: DataFrame, narrators: tuple[str, ...]) -> DataFrame:
    own = lambda x: x.role == F.col("speaker")
    runs = lambda x: F.concat(F.length(_head(x, narrators)), F.lit(":0,"), F.length(_rest(x)), F.when(own(x), ":1").otherwise(":0"))
    trained = F.aggregate("turns", F.lit(0), lambda n, x: n + F.when(own(x), F.length(_rest(x))).otherwise(0))
    return rows.select(
        "conv_id",
        "speaker",
        "part",
        "piece",
        "before",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(_head(x, narrators), _rest(x))), "").alias("text"),
        F.array_join(F.transform("turns", runs), ",").alias("mask"),
        trained.cast("long").alias("n_trained"),
    )
