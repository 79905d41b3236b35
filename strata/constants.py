"""Codes and thresholds that stored rows and results depend on."""

# Category codes as stored.
PLAIN, DUPLICATE, OTHER, UNSORTED, UNKNOWN = "傳送", "疑似重複", "其他檔案", "未分類", "未知"
SCREENSHOT_CATEGORY, DOCUMENT_CATEGORY = "截圖", "文件收據"
LEGACY_BATCH = "legacy"

# Reasons as stored.
REASON_SHOT_SIZE, REASON_SHOT_NAME, REASON_DOCUMENT = "截圖尺寸", "截圖檔名", "文件檔"
REASON_MANUAL, REASON_AI, REASON_LEARNED = "你手動分類", "AI 判斷", "像你分類過的檔案"
REASON_REINDEX, REASON_UNKNOWN_TYPE, REASON_UNSURE = "索引需要重建", "無法分析的檔案類型", "AI 無法判斷"

# Extensions by kind.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "bmp", "gif", "tif", "tiff")
VIDEO_EXTENSIONS = ("mov", "mp4", "m4v", "avi", "mkv", "3gp", "webm")
DOCUMENT_EXTENSIONS = ("pdf", "docx", "txt", "md", "csv", "rtf")

# Words in the names of screenshots.
SCREENSHOT_WORDS = ("screenshot", "screen_shot", "screen shot", "screencapture", "螢幕截圖", "螢幕擷取", "截圖", "截屏", "スクリーンショット")

# Screen sizes (shorter side, longer side) of phones and tablets, as makers publish them; which of them count is fixed by what is stored.
SCREENS = (
    (720, 1280), (720, 1520), (720, 1560), (720, 1600), (720, 1612), (720, 1640), (750, 1334), (828, 1792), (1008, 2244),
    (1080, 1920), (1080, 2160), (1080, 2220), (1080, 2232), (1080, 2244), (1080, 2280), (1080, 2310), (1080, 2340), (1080, 2376),
    (1080, 2388), (1080, 2400), (1080, 2408), (1080, 2412), (1080, 2436), (1080, 2460), (1080, 2520), (1125, 2436), (1170, 2532),
    (1179, 2556), (1206, 2622), (1220, 2712), (1240, 2772), (1242, 2208), (1242, 2688), (1260, 2800), (1264, 2780), (1280, 2800),
    (1280, 2856), (1284, 2778), (1290, 2796), (1320, 2868), (1344, 2992), (1440, 2560), (1440, 2880), (1440, 2960), (1440, 3040),
    (1440, 3088), (1440, 3120), (1440, 3168), (1440, 3200), (1488, 2266), (1536, 2048), (1600, 2560), (1620, 2160), (1640, 2360),
    (1668, 2388), (1800, 2880), (2048, 2732),
)

# Thresholds.
TEMPERATURE, MIN_CONFIDENCE, DOUBT_CONFIDENCE, DOUBT_CLOSE_RATIO = 50.0, 0.35, 0.5, 0.6
LEARN_SIMILARITY, NEAR_DUPLICATE, OCR_DOC_CHARS, OCR_DOC_BOOST = 0.82, 0.97, 30, 0.02
EMBED_DIM, VIDEO_SEG_MAX, EARTH_KM, TAIWAN_KM, CITY_KM = 256, 150, 6371.0, 10.0, 80.0

# Characters that matching ignores, besides white space.
IGNORED_IN_MATCH = ",，、。.·:：;；'\"「」『』()（）[]【】-_—~～|/\\"

# Names that Windows keeps for devices.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
