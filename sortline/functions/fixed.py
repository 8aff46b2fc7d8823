"""Codes, texts and tables that results must show as they are."""

#: Task status.
CREATED, SCANNED, DROPPED, FEEDBACK_PENDING, EXCEPTION = 1, 2, 3, 4, 5
#: Where a task comes from.
UNKNOWN, SPLIT, FULL_CASE = 0, 1, 2
#: Feedback status.
NOT_REQUIRED, PENDING, COMPLETED, FAILED, PROCESSING = 0, 1, 2, 3, 4
#: Status of a sync batch.
BATCH_PENDING, BATCH_RUNNING, BATCH_COMPLETED, BATCH_FAILED = 1, 2, 3, 4

NO_WAVE = "未分波次"
NO_DOCK = "未分配码头"

STATUS_TEXT = {1: "已创建", 2: "已扫描", 3: "已落格", 4: "待回传", 5: "异常"}
UNKNOWN_STATUS_TEXT = "未知状态"
SOURCE_TEXT = {1: "拆零", 2: "整件"}
UNKNOWN_SOURCE_TEXT = "未知来源"
YES, NO = "是", "否"

WAVE_EXCEPTION, WAVE_SORTING, WAVE_DONE = "异常待处理", "分拣中", "已完成"
BOX_UNMATCHED, BOX_MATCHED, BOX_EXCEPTION, BOX_RECIRCULATED, BOX_SCANNED = "未匹配", "已匹配", "异常待处理", "回流复扫", "已扫描"

#: Zones in their output order, with names, and the working areas of each split zone.
ZONES = (
    ("SplitZone1", "拆零区1", ("1", "YA1", "A1")),
    ("SplitZone2", "拆零区2", ("2", "YA2", "A2")),
    ("SplitZone3", "拆零区3", ("3", "YB1", "B1")),
    ("SplitZone4", "拆零区4", ("4", "YB2", "B2")),
    ("FullCase", "整件区", ()),
)

#: Docks above this recirculate; exceptions are shown for dock seven alone.
LAST_DOCK = 7
EXCEPTION_DOCK = 7

#: Drop rejections.
DROP_INVALID, DROP_NO_TASK, DROP_BARCODE, DROP_STATUS, DROP_NO_CHUTE = "参数校验失败", "未找到任务", "条码不一致", "任务状态不允许落格回传", "实际落格编码不能为空"

#: Headers of the CSV reports.
WAVE_LIST_HEADERS = ("波次号", "备注", "包裹总数", "待分拣数", "拆零总数", "整件总数", "拆零未分拣数量", "整件未分拣数量", "回流数", "异常数", "创建时间", "状态")
ZONE_HEADERS = ("区域名称", "总数", "待分拣数", "进度百分比", "回流数", "异常数")
SORTING_HEADERS = ("码头号", "拆零总数", "整件总数", "拆零分拣数", "整件分拣数", "回流数", "异常数")
RECIRCULATION_HEADERS = ("格口", "波次号", "回流数")
DETAIL_HEADERS = ("任务编码", "波次号", "波次备注", "来源类型", "作业区域", "条码", "订单号", "门店号", "门店名称", "商品编码", "拣货位", "格口", "状态", "是否回流", "是否异常", "扫描时间", "创建时间", "更新时间")
DOCK_HEADERS = ("码头号", "拆零待分拣数", "整件待分拣数", "回流数", "异常数", "已分拣数", "分拣进度百分比")
BOX_HEADERS = ("订单号", "箱号", "门店号", "门店名称", "商品编码", "拣货位", "扫描设备", "扫描时间", "格口", "状态")
PAIR_HEADERS = ("指标", "值")
GLOBAL_LABELS = (
    "总件数", "待分拣数", "总分拣进度百分比", "整件总数", "整件待分拣数", "整件分拣进度百分比", "拆零总数", "拆零待分拣数", "拆零分拣进度百分比",
    "读码率百分比", "回流数", "异常数", "总体积(mm3)", "总重量(g)", "最新同步时间", "数据下载进度百分比", "数据回写进度百分比",
)
