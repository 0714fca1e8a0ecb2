"""Names, labels and weights that results depend on."""

from __future__ import annotations

# Scenes, their labels and the keys of older releases.
SCENES = ("people", "sports", "landscape", "city", "indoor", "detail", "animals", "other")
SCENE_LABELS_ZH = {"people": "人物", "sports": "运动", "landscape": "风光", "city": "城市", "indoor": "室内", "detail": "特写", "animals": "动物", "other": "其他"}
SCENE_LABELS_EN = {"people": "People", "sports": "Sports", "landscape": "Landscape", "city": "City", "indoor": "Indoor", "detail": "Detail", "animals": "Animals", "other": "Other"}
LEGACY_SCENES = {
    "concert": "people", "portrait": "people", "landscape": "landscape", "cityscape": "city", "food": "detail", "indoor": "indoor",
    "macro": "detail", "sports": "sports", "wildlife": "animals", "other": "other", "street": "other", "travel": "other",
}

# Score dimensions, in their order, with short names and labels.
VISION_DIMS = ("subject", "composition", "lighting", "color", "clarity", "depth", "mood")
ALL_DIMS = ("exposure", "sharpness", *VISION_DIMS)
ABBREVIATIONS = {"exposure": "exp", "sharpness": "sharp", "subject": "subj", "composition": "comp", "lighting": "lit", "color": "color", "clarity": "clar", "depth": "dep", "mood": "mood"}
AESTHETIC_DIMS = ("subject_moment", "composition", "lighting", "color", "depth_separation", "mood_story")
AESTHETIC_SOURCE = {"subject_moment": "subject", "composition": "composition", "lighting": "lighting", "color": "color", "depth_separation": "depth", "mood_story": "mood"}
DIM_LABELS_EN = {
    "exposure": "Exposure", "sharpness": "Sharpness", "subject": "Subject", "subject_moment": "Subject Moment", "composition": "Composition",
    "lighting": "Lighting", "color": "Color", "clarity": "Clarity", "depth": "Depth", "depth_separation": "Depth Separation", "mood": "Mood",
    "mood_story": "Mood Story", "technical_quality": "Technical Quality", "subject_focus": "Subject Focus", "space_depth": "Space Depth",
    "portrait_face_eye_usability": "Portrait Face/Eye Usability",
}
DIM_LABELS_ZH = {
    "exposure": "曝光", "sharpness": "锐度", "subject": "主体", "subject_moment": "关键瞬间", "composition": "构图", "lighting": "光线", "color": "色彩",
    "clarity": "清晰", "depth": "层次", "depth_separation": "空间层次", "mood": "氛围", "mood_story": "氛围", "technical_quality": "技术质量",
    "subject_focus": "主体对焦", "space_depth": "空间层次", "portrait_face_eye_usability": "人物可用性",
}

# Weights of the seven dimensions per scene.
SCENE_WEIGHTS = {
    "default": {"subject": 0.18, "composition": 0.17, "lighting": 0.16, "color": 0.14, "clarity": 0.17, "depth": 0.08, "mood": 0.10},
    "people": {"subject": 0.28, "composition": 0.15, "lighting": 0.15, "color": 0.10, "clarity": 0.20, "depth": 0.05, "mood": 0.07},
    "sports": {"subject": 0.25, "composition": 0.13, "lighting": 0.12, "color": 0.08, "clarity": 0.25, "depth": 0.07, "mood": 0.10},
    "landscape": {"subject": 0.08, "composition": 0.22, "lighting": 0.20, "color": 0.18, "clarity": 0.12, "depth": 0.12, "mood": 0.08},
    "city": {"subject": 0.10, "composition": 0.22, "lighting": 0.18, "color": 0.14, "clarity": 0.12, "depth": 0.12, "mood": 0.12},
    "indoor": {"subject": 0.20, "composition": 0.17, "lighting": 0.20, "color": 0.14, "clarity": 0.15, "depth": 0.05, "mood": 0.09},
    "detail": {"subject": 0.20, "composition": 0.20, "lighting": 0.16, "color": 0.16, "clarity": 0.18, "depth": 0.05, "mood": 0.05},
    "animals": {"subject": 0.28, "composition": 0.14, "lighting": 0.14, "color": 0.10, "clarity": 0.22, "depth": 0.05, "mood": 0.07},
    "other": {"subject": 0.18, "composition": 0.17, "lighting": 0.16, "color": 0.14, "clarity": 0.17, "depth": 0.08, "mood": 0.10},
}

# Exposure profile of each scene, in the order of EXPOSURE_FIELDS.
EXPOSURE_FIELDS = (
    "shadow_soft", "shadow_hard", "highlight_soft", "highlight_hard", "median_target", "median_tolerance", "span_bad", "span_good",
    "w_shadow", "w_highlight", "w_median", "w_span",
)
EXPOSURE_PROFILES = {
    "default": (0.45, 0.75, 0.03, 0.12, 0.42, 0.30, 0.02, 0.12, 0.30, 0.20, 0.45, 0.05),
    "people": (0.80, 0.95, 0.06, 0.18, 0.18, 0.22, 0.02, 0.12, 0.10, 0.20, 0.45, 0.25),
    "indoor": (0.72, 0.92, 0.05, 0.16, 0.24, 0.20, 0.02, 0.10, 0.15, 0.20, 0.45, 0.20),
    "landscape": (0.35, 0.65, 0.03, 0.12, 0.42, 0.18, 0.04, 0.16, 0.35, 0.20, 0.30, 0.15),
    "city": (0.45, 0.72, 0.04, 0.14, 0.32, 0.18, 0.03, 0.14, 0.30, 0.25, 0.30, 0.15),
    "sports": (0.55, 0.82, 0.05, 0.16, 0.30, 0.18, 0.03, 0.12, 0.20, 0.25, 0.35, 0.20),
    "detail": (0.60, 0.86, 0.05, 0.16, 0.28, 0.20, 0.03, 0.10, 0.18, 0.22, 0.38, 0.22),
    "animals": (0.55, 0.82, 0.05, 0.16, 0.30, 0.20, 0.03, 0.12, 0.20, 0.22, 0.38, 0.20),
    "other": (0.50, 0.80, 0.04, 0.14, 0.34, 0.22, 0.03, 0.12, 0.25, 0.22, 0.38, 0.15),
}

# Words in a free scene text that suggest a scene; the first scene with a hit wins.
SCENE_KEYWORDS = {
    "animals": ("猫", "狗", "鸟", "宠物", "小狗", "小猫", "飞鸟", "动物"),
    "city": ("城市", "街头", "街景", "霓虹", "夜景", "楼", "建筑", "路口"),
    "landscape": ("山", "海", "日落", "日出", "湖", "草原", "云海", "风光"),
    "indoor": ("室内", "房间", "客厅", "咖啡馆", "餐厅", "展馆", "书店"),
    "detail": ("特写", "细节", "近景", "食物", "咖啡", "甜点", "寿司", "花"),
    "people": ("人物", "人像", "主唱", "歌手", "吉他手", "观众", "男孩", "女孩", "人"),
    "sports": ("跑步", "比赛", "足球", "篮球", "运动", "冲刺", "骑行"),
}
