"""Word lists, limits and formats that decide results. Kept as plain text."""

# fixed values: file extensions of page assets
ASSET_EXTS = ["png", "jpg", "jpeg", "webp"]

# fixed values: heading lists of the overview, page and panel documents, in order
OVERVIEW_HEADINGS = ["# 总体复述", "# 氛围基调", "# 叙事逻辑链", "# 人物关系"]
PAGE_HEADINGS = ["# 剧情脉络", "# 分镜顺序与衔接", "# 与前后页的承接"]
PANEL_HEADINGS = [
    "## 分镜编号与位置", "## 出场人物", "## 动作与姿态", "## 空间关系与构图", "## 镜头角度",
    "## 背景环境", "## 对白原文", "## 拟声词", "## 氛围与情绪", "## 备注",
]
SEGMENT_HEADINGS = [
    "## 内容改写（静态到动态）", "## 逐秒镜头设计", "## 声音设计", "### 对白",
    "### 环境与动作音效", "### 配乐", "## 出场人物及衣着锚定",
]

# fixed values: gender words and their canonical form
GENDER_WORDS = {
    "female": ["female", "f", "woman", "girl", "女", "女性", "少女"],
    "male": ["male", "m", "man", "boy", "男", "男性", "少年"],
}

# fixed values: markers for "nobody here" and "none"
EMPTY_CAST_MARKERS = ["（无）", "(无)", "无出场", "无人出场", "无人物"]
NONE_MARKERS = ["（无）", "(无)"]
NONE_PREFIXES = ["（无", "(无"]
NOTE_WORDS = ["注", "本镜", "说明", "旁白说明", "画外音说明"]
NARRATION_MARK = "旁白"

# fixed values: default texts
NO_TEXT, NO_GIST, NO_STATES, FALLBACK_BEAT = "（无）", "（见 L3 脚本）", "（未定义）", "（确定性兜底分段）"

# fixed values: size buckets (width, height) and aspect limits
SIZE_BUCKETS = {"vertical": (1024, 1408), "horizontal": (1408, 1024), "square": (1216, 1216)}
ASPECT_LOW, ASPECT_HIGH = 0.8, 1.25
HD_FACTOR = 1.5

# fixed values: box rules
BOX_MARGIN = 0.03
BOX_MIN_SIDE = 0.005
PLACEMENT_SLACK = 1.01

# fixed values: attempts
SEED_STEP = 7919
MAX_ATTEMPTS = 3
PASS_SCORE = 7
MAX_SCORE = 10
FIRST_PASS_MIN, MEAN_ATTEMPTS_MAX, REVIEW_MAX, SCORE_MIN = 0.5, 1.8, 0.1, 7.0

# fixed values: segments and timeline
UNIT_SECONDS = 5.0
MAX_SEGMENT_SECONDS = 15.0
CROSSFADE_SECONDS = 0.45
DURATION_TOLERANCE = 0.5
FPS_DEFAULT, RATE_DEFAULT, LAYOUT_DEFAULT = 24.0, 48000, "stereo"

# fixed values: tags
QUALITY_TAIL = ",masterpiece,best quality,"
EXCLUDE_WHEN_FEMALE = ["1boy", "male", "man", "boy", "gender swap", "gender change"]
EXCLUDE_WHEN_MALE = ["1girl", "female", "woman", "girl", "gender swap", "gender change"]
FIRST_TAGS = ["1girl", "1boy", "2girls", "2boys"]

# fixed values: video prompt format
I2VA_FIRST_LINE = (
    "For the target video, at 0.00 seconds into the target video, "
    "<Picture 1> (from [Shot 1]) is fully referenced."
)
LOCK_PHRASE = "identity lock, no identity swap, no changing face or hairstyle"
PROMPT_FIELDS = ["integrated_multimodal_description:", "overall_soundscape:", "non_diegetic_music:"]
DEFAULT_SOUNDSCAPE = (
    "overall_soundscape: Ambient environmental soundscape matching the animation scene, "
    "with subtle dynamic presence."
)
DEFAULT_MUSIC = (
    "non_diegetic_music: Orchestral background soundtrack with dynamic tempo changes "
    "supporting visual beats."
)

# fixed values: alias names of the top-level record columns
RECORD_ALIASES = {
    "characters": ["characters", "character", "chars", "char_list", "character_list"],
    "environments": ["environments", "environment", "envs", "scenes", "scene_list"],
    "style_notes": ["style_notes", "style_note", "style", "art_style", "notes"],
}

# fixed values: stage order, stage dependencies and status letters
FINAL_STATES = ["completed", "needs_review"]
STAGES = ["s0", "s1", "s2", "s3", "s4", "s4b", "s5", "s6", "s7", "s8"]
STAGE_DEPS = [
    ("s1", "s0"), ("s2", "s1"), ("s3", "s2"), ("s4", "s3"), ("s4b", "s3"),
    ("s5", "s2"), ("s6", "s5"), ("s7", "s5"), ("s8", "s7"),
]
STATUS_LETTERS = {"pending": ".", "in_progress": ">", "completed": "C", "failed": "!"}

# fixed values: hook words of the shot table gate
HOOK_TURNS = ["reveal", "reversal", "callback"]
HOOK_STRONG = ["visual-joke", "reversal", "reveal", "suspense", "tender"]
SHOT_MAX_SECONDS, SHOT_MAX_CAST = 15.0, 3

# fixed values: style labels and guard texts
STYLE_GUARDS = {
    "2d": "Flat 2D cel-shaded animation style, NOT realistic live-action, NOT 3D CGI.",
    "3d": "Stylized 3D CGI animation style, NOT flat 2D, NOT live-action.",
    "live": "Realistic live-action cinematic style, NOT 3D CGI, NOT cartoon.",
}
