"""Numbers and names that results depend on."""

# Frame geometry and region of interest.
SIZE_PX = 640
ROI_CENTER = (0.5, 0.5)
ROI_RADIUS = 0.45
SUBJECT_RADIUS_FRAC = 0.42

# Subject detection.
BORDER_FRAC = 0.06
DETECT_K = 4.0
MIN_AREA_FRAC = 0.005
MIN_RADIUS_FRAC = 0.15
MAX_RADIUS_FRAC = 0.95
FALLBACK_RADIUS_FRAC = 0.4
VISIBLE_MIN_ABS_A = 6.0
GARLIC_GROW = 0.6
GARLIC_WINDOW_FRAC = 0.55
GARLIC_VISIBLE_MIN_AREA_FRAC = 0.003
OTSU_MIN_VALUES = 100
PAD_WARN_FRAC = 0.25

# Blob detection.
FINE_WINDOW_PX = 41
COARSE_WINDOW_PX = 181
FINE_K = 3.0
COARSE_K = 2.2
FINE_FLOOR = 10.0
COARSE_FLOOR = 4.0
EXCLUSION_DILATE_PX = 6
SMALL_AREA_MIN_PX = 12
SMALL_AREA_MAX_PX = 500
LARGE_AREA_MIN_PX = 1200

# Pixel features.
SATURATION = 250
MAD_SCALE = 1.4826
ANOMALY_K = 3.0
EPS = 1e-6
DISCOLOR_HUE = (10, 40)
DISCOLOR_SAT_MIN = 40
NO_VISIBLE = -1.0

# Consistency checks.
RADIUS_SPREAD_MAX = 0.25
BACKGROUND_RATIO_MAX = 1.25
BACKGROUND_MIN_LEVEL = 4.0
RANGE_TOLERANCE = 0.25
SETTING_TAGS = ["ISOSpeedRatings", "ExposureTime", "FNumber"]

# Capture sessions and stores.
SESSION_TTL_SECONDS = 1800
CAPTURE_STEPS = [("V1", "uv", True), ("VISIBLE", "visible", False)]
CODE_MAX_CHARS = 32
CROPS = ["onion", "garlic"]
CROPS_WITH_MODEL = ["onion"]
UPLOAD_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".dng"]
LIST_LIMIT_DEFAULT = 200
LIST_LIMIT_MAX = 500

# Evaluation.
SEED = 42
HOLDOUT_SEED_OFFSET = 100
OUTER_SPLITS = 5
INNER_SPLITS = 4
OOF_REPEATS = 20
BOOTSTRAP_REPLICATES = 4000
PASS_BAR = {"accuracy": 0.80, "recall": 0.80, "kappa": 0.61}
REDUNDANT_CORR = 0.95
DEPLOYED_THRESHOLD = 0.6746431704811802

# The features of one view, in table order.
VIEW_FEATURES = [
    "mean_R", "mean_G", "mean_B", "sd_R", "sd_G", "sd_B",
    "brightness_mean", "brightness_sd", "texture",
    "A_high", "A_low", "F_p95", "F_p05", "blob_max",
    "NDFI_mean", "NDFI_p95", "NDFI_p05",
    "n_small_sharp_blobs", "n_large_blotches",
    "avg_small_blob_diam_px", "avg_large_blotch_diam_px",
    "cluster_density", "ratio_small_to_large",
]
HEAD_FEATURES = ["uv_exclusive_dot_frac"]

# Feature groups used by the row-wise transforms.
INTENSITY_FEATURES = [
    "mean_R", "mean_G", "mean_B", "sd_R", "sd_G", "sd_B",
    "brightness_mean", "brightness_sd", "texture", "F_p95", "F_p05",
]
COLOUR_FEATURES = ["mean_R", "mean_G", "mean_B", "sd_R", "sd_G", "sd_B"]
HEAVY_TAILED_FEATURES = [
    "blob_max", "n_small_sharp_blobs", "n_large_blotches",
    "avg_small_blob_diam_px", "avg_large_blotch_diam_px",
    "A_high", "A_low", "cluster_density",
]
WATCHED_PREFIXES = ["NDFI_mean", "NDFI_p95", "NDFI_p05", "A_low"]
