"""Word lists, tables and constants that results depend on.

Everything here is data, not logic. Values are stated as they are because any other
value would give other results.
"""

from __future__ import annotations

# ---- name -> family, for object identity -------------------------------------------
NAME_FAMILY = {
    "椅子": "chair", "办公椅": "chair", "座椅": "chair",
    "沙发": "sofa", "马桶": "toilet", "风扇": "fan", "落地扇": "fan",
    "电风扇": "fan", "笔记本电脑": "laptop", "电脑": "laptop",
    "显示器": "monitor", "电脑显示器": "monitor",
    "床": "bed", "鼠标": "mouse", "杯子": "cup", "花筒": "vase", "水桶": "bucket",
}

# ---- class -> family, for association across frames --------------------------------
CLASS_FAMILY = {
    "cup": "container", "mug": "container", "water cup": "container", "bottle": "container",
    "vase": "container", "flower vase": "container", "bucket": "container",
    "water bucket": "container", "plastic bucket": "container", "flower bucket": "container",
    "trash can": "container", "trash bin": "container", "wastebin": "container",
    "waste basket": "container", "garbage can": "container", "flower pot": "container",
    "plant pot": "container", "planter": "container", "垃圾桶": "container", "水桶": "container",
    "花筒": "container", "杯子": "container",
    "chair": "furniture", "stool": "furniture", "table": "furniture", "desk": "furniture",
    "coffee table": "furniture", "sofa": "furniture", "couch": "furniture", "bed": "furniture",
    "dining table": "furniture", "sink": "furniture", "toilet": "furniture", "沙发": "furniture",
    "桌子": "furniture", "茶几": "furniture",
    "laptop": "electronics", "cell phone": "electronics", "phone": "electronics",
    "smartphone": "electronics", "remote": "electronics", "remote control": "electronics",
    "mouse": "electronics", "computer mouse": "electronics", "keyboard": "electronics",
    "tv": "electronics", "television": "electronics", "clock": "electronics", "电视": "electronics",
    "遥控器": "electronics", "鼠标": "electronics", "键盘": "electronics", "手机": "electronics",
    "pillow": "textile", "cushion": "textile", "blanket": "textile", "quilt": "textile",
    "被子": "textile", "枕头": "textile",
    "potted plant": "plant", "花盆": "plant",
    "book": "paper", "书本": "paper",
}
# Families in which differently labelled views of one object may be joined.
TIGHT_FAMILIES = ("container", "textile", "plant")

# ---- query word -> label synonyms ---------------------------------------------------
SYNONYMS = {
    "水桶": ["bucket", "plastic bucket", "water bucket"],
    "桶": ["bucket", "trash can", "trash bin", "wastebin"],
    "垃圾桶": ["trash can", "trash bin", "wastebin", "waste basket", "garbage can"],
    "花筒": ["vase", "flower vase", "bucket", "flower pot"],
    "花瓶": ["vase", "flower vase", "bottle"],
    "杯子": ["cup", "mug", "bottle"],
    "遥控器": ["remote", "remote control"],
    "鼠标": ["mouse", "computer mouse"],
    "键盘": ["keyboard"],
    "手机": ["cell phone", "phone", "smartphone"],
    "被子": ["blanket", "quilt"],
    "枕头": ["pillow", "cushion"],
    "床": ["bed"],
    "桌子": ["table", "desk", "coffee table"],
    "沙发": ["sofa", "couch"],
    "椅子": ["chair", "armchair", "office chair"],
    "风扇": ["fan", "electric fan", "standing fan"],
    "电视": ["tv", "television"],
    "笔记本电脑": ["laptop"],
    "瑜伽垫": ["trash can", "trash bin", "bucket"],
}

# Spoken phrases removed from a question, in this order.
QUESTION_PHRASES = (
    "在哪里", "在哪儿", "在哪", "哪里", "哪儿",
    "什么颜色", "颜色", "是什么东西", "是什么", "是啥", "在什么地方",
)

# ---- display words -------------------------------------------------------------------
LABEL_ZH = {
    "cup": "杯子", "mug": "马克杯", "bottle": "瓶子", "laptop": "笔记本电脑",
    "mouse": "鼠标", "keyboard": "键盘", "remote": "遥控器", "cell phone": "手机",
    "chair": "椅子", "sofa": "沙发", "table": "桌子", "dining table": "餐桌",
    "trash can": "垃圾桶", "trash bin": "垃圾桶", "bucket": "水桶",
    "plastic bucket": "水桶", "water bucket": "水桶", "pillow": "枕头",
    "blanket": "被子", "tv": "电视", "support_surface": "桌面", "wall": "墙面",
    "indoor_scene": "室内",
}
DIRECTION_ZH = {
    "front": "前方", "left": "左方", "right": "右方", "behind": "后方",
    "left_front": "左前方", "right_front": "右前方",
}
# predicate -> text around the object
PREDICATE_ZH = {
    "on": "在{}上",
    "above": "在{}上方",
    "below": "在{}下方",
    "near": "在{}附近",
    "in": "在{}里",
    "left_of": "在{}左边",
    "right_of": "在{}右边",
    "front_of": "在{}前方",
    "behind": "在{}后面",
}
# hue range in degrees [from, to) -> colour
HUE_RANGES = [
    (0, 15, "红色"), (15, 45, "橙色"), (45, 70, "黄色"), (70, 160, "绿色"),
    (160, 200, "青色"), (200, 255, "蓝色"), (255, 285, "紫色"), (285, 330, "粉色"),
    (330, 360, "红色"),
]
BLACK, WHITE, LIGHT_GREY, DARK_GREY, COLOURFUL = "黑色", "白色", "浅灰色", "深灰色", "彩色"
UNSURE = "不确定"

# expected short name -> spoken names, for naming checks
NAMING_EN = {
    "笔记本电脑": "laptop", "笔记本": "laptop", "电脑": "laptop",
    "杯子": "cup", "马克杯": "cup", "杯": "cup",
    "鼠标": "mouse", "花筒": "flower_pot", "水桶": "bucket", "桶": "bucket",
    "床": "bed", "椅子": "chair", "办公椅": "chair", "风扇": "fan", "电风扇": "fan",
}
LAPTOP_WORDS = ("laptop", "笔记本", "电脑")
CUP_WORDS = ("cup", "杯")
POT_WORDS = ("桶", "盆", "罐", "花", "花瓶", "bucket", "vase", "pot", "trash", "bin")

# ---- relation confidences --------------------------------------------------------------
CONF_ON_OBJECT, CONF_ABOVE, CONF_NEAR, CONF_ON_SUPPORT, CONF_IN = 0.8, 0.8, 0.7, 0.75, 0.95

# ---- confirmation weights ---------------------------------------------------------------
MULTI_VIEW_WEIGHT = 0.7

# ---- model output ------------------------------------------------------------------------
RISK_ALIAS = {
    "": "none", "no": "none", "safe": "none", "normal": "none",
    "warn": "medium", "warning": "medium", "danger": "high", "critical": "high",
    "无": "none", "低": "low", "中": "medium", "高": "high",
}
RISK_LEVELS = ("none", "low", "medium", "high")
RISK_TO_REPLY = {"high": "alert", "medium": "voice", "low": "text", "none": "noop"}
REJECT_MESSAGES = {
    "too_small": "图像数据异常", "too_large": "图像过大", "decode_failed": "图像无法识别",
    "too_low_resolution": "画面分辨率过低", "too_blurry": "画面模糊，请稳一下",
    "face_detected": "画面含人脸，已跳过", "banned_word": "内容不可展示",
    "read_rate_limit": "阅读太频繁，请稍后再试",
}
REJECT_DEFAULT = "本帧已跳过"
ERROR_MESSAGE = "识别失败，请稍后重试"
EMPTY_READ_MESSAGE = "未发现文字"
NO_TEXT_SENTINEL = "未发现文字"
SENTINEL_TRIM = " \t\r\n。.！!，,、"
ELLIPSIS = "…"
NOT_FOUND_TEXT = "记忆中没找到，让我看看画面"
FROM_MEMORY_PREFIX = "根据记忆，"
FILTERED_TEXT = "[内容已过滤]"
SENTENCE_END = "。！？!?；;"
CLAUSE_END = "，、,：:）)】」』》"

# ---- redaction, in this order --------------------------------------------------------------
MASK = "***"
REDACT_PATTERNS = (
    ("id_card", r"\d{17}[\dXx]"),
    ("bank_card", r"\d{16,19}"),
    ("phone", r"1[3-9]\d{9}"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    (
        "plate",
        r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤川青藏琼宁]"
        r"[A-Z][A-Z0-9]{5}",
    ),
)

# ---- prompt injection, any match counts ------------------------------------------------------
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?(previous\s+)?instructions",
    r"you\s+are\s+now\s+",
    r"system\s+prompt",
    r"repeat\s+(the\s+|your\s+)?instructions",
    r"output\s+(your\s+|the\s+)?system\s+(prompt|message)",
    r"disregard\s+(all\s+|previous\s+)?(rules|instructions|prompts)",
    r"forget\s+(all\s+|your\s+)?(previous\s+)?(rules|instructions|prompts)",
    r"pretend\s+(you\s+are|to\s+be)",
    r"act\s+as\s+if\s+you\s+(are|have\s+no)",
    r"忽略.*(之前|以上|所有).*(指令|规则|提示词)",
    r"你现在是",
    r"输出.*(系统|你的).*(提示词|指令|prompt)",
)

# ---- latency histogram bounds, seconds ---------------------------------------------------------
E2E_BUCKETS = (0.05, 0.2, 0.5, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 8.0)
NODE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
