"""Fixed values of the rules: they must be what they are for results to be right."""

# Categories and their extensions.
CATEGORIES = {
    "Images": "jpg jpeg png gif webp bmp heic heif tiff tif svg ico",
    "Videos": "mp4 mkv avi mov 3gp webm m4v flv wmv mpg mpeg",
    "Audio": "mp3 wav m4a aac opus ogg flac amr wma",
    "Documents/PDFs": "pdf",
    "Documents/Office": "doc docx xls xlsx ppt pptx odt ods odp",
    "Documents/Other": "txt rtf csv md json xml log html htm epub mobi",
    "Archives": "zip rar 7z tar gz bz2 xz",
    "Installers": "apk exe msi appx deb rpm dmg",
    "Code": "py js ts java c cpp cs go rb php sh bat ps1 sql yml yaml",
}
TOP_BUCKETS = ["Images", "Videos", "Audio", "Documents", "Archives", "Installers", "Code", "Other"]
# What counts as a picture or a film to look at.
IMAGE_EXTS = "jpg jpeg png webp bmp heic heif tif tiff gif".split()
VIDEO_EXTS = CATEGORIES["Videos"].split()
# Leading bytes of file types, in the order they are tried.
MAGIC = [
    ("89504e47", "png"), ("ffd8ff", "jpg"), ("474946", "gif"), ("25504446", "pdf"), ("49492a00", "tiff"), ("4d4d002a", "tiff"), ("504b0304", "zip"), ("d0cf11e0", "doc"), ("4d5a", "exe"),
    ("494433", "mp3"), ("fffb", "mp3"), ("1f8b", "gz"), ("526172211a", "rar"), ("377abcaf271c", "7z"), ("3c3f786d6c", "xml"), ("3c68746d6c", "html"), ("3c21444f43", "html"),
]
# Names in a zip container that tell its real type, in order.
ZIP_MARKS = [("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("AndroidManifest.xml", "apk"), ("classes.dex", "apk")]
# Size tiers, from their least number of MiB.
TIERS = [(50, "1_Huge_over_50MB"), (20, "2_Large_20_50MB"), (5, "3_Medium_5_20MB"), (1, "4_Small_1_5MB"), (0, "5_Tiny_under_1MB")]
JUNK_EXTS = "tmp temp log cache crdownload part partial bak old dmp thumb".split()
JUNK_REVIEW, DUP_REVIEW, SIMILAR_REVIEW = "Junk_Files_Review", "Duplicates_Review", "Similar_Names_Review"
PROTECTED_FIRST = "android miui ringtones notifications alarms lost.dir system data obb".split()
PROTECTED_ANY = ".thumbnails .globaltrash sent private".split()
GENERATED_FOLDERS = ["Compressed_Images", "Originals_Backup"]
# Fixed value: suffixes that copies of a file get, at the end of a stem.
COPY_SUFFIX = r"(?:\s*\(\d+\)|\s*-\s*cop(?:y|ie)[a-z0-9 ]*|\s*_cop(?:y|ie)[a-z0-9 ]*|\s+cop(?:y|ie)[a-z0-9 ]*|\s*-\s*\d+)\s*$"
PHOTO_FOLDERS = {
    "screenshot": "Screenshots", "document": "Documents_Scans", "best": "Best_Shots", "blurry": "Blurry_Shaken", "duplicate": "Duplicates", "similar": "Similar_Extras",
    "group": "Group_Photos", "couple": "Couples", "single": "Portraits_Single", "scenery": "Scenery_Others", "video": "Videos",
}
PHOTO_BLUR, PHOTO_DUP, PHOTO_SIMILAR, PHOTO_BEST, FACE_CLUSTER, FACE_NAME = 50.0, 8, 16, 0.72, 0.363, 0.40
SCREENSHOT_MARKS = ["screenshot", "screen shot", "screencap", "screen_shot", "screen recording"]
SESSION_NAMES = ["Getting Ready", "Nishchayam (Engagement)", "Muhurtham (Ceremony)", "Thalikettu / Ring Exchange", "Sadhya (Feast)", "Group Photos", "Nalangu", "Reception", "Sendoff"]
# Folder tags, first by exact name, then hidden folders and those of exactly a system name, then by the first keyword found.
FOLDER_EXACT = {"android": "system", "miui": "system", "ringtones": "system", ".config": "system", "whatsapp_media": "extracted", "telegram_media": "extracted", "documents": "documents", "subtitles": "documents"}
FOLDER_SYSTEM = "android miui ringtones notifications alarms".split()
FOLDER_KEYWORDS = [
    ("extracted", "whatsapp telegram"), ("reclaim", "download large 1gb backup"),
    ("media", "dcim picture image movie video photo insta camera"), ("documents", "document subtitle preset pdf"),
]
FOLDER_NOTES = {
    "system": "System / app-critical — not modified", "extracted": "Extracted from app storage", "documents": "Documents",
    "reclaim": "Large — back up then delete to reclaim space", "media": "Organised media library", "personal": "Personal / misc",
}
RECLAIM_BYTES, RECLAIM_DAYS = 20 * 1024**2, 180
EXT_CATEGORY = {ext: category for category, exts in CATEGORIES.items() for ext in exts.split()}
