"""Values that decide results and therefore have to be exactly these."""

# Closed option lists of a resize request.
RESAMPLE_METHODS = ["nearest-exact", "bilinear", "area", "bicubic", "lanczos"]
RESIZE_MODES = ["stretch", "resize", "pad", "pad_edge", "pad_edge_pixel", "crop", "pillarbox_blur", "total_pixels"]
ANCHORS = ["center", "top", "bottom", "left", "right"]

# File suffixes.
VIDEO_SUFFIXES = [".avi", ".m2ts", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".webm", ".wmv"]
IMAGE_SUFFIXES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"]

# Names, formats and defaults of frame sequences.
FRAME_NAME_FORMAT = "frame_%08d.png"
FRAME_FILES = r"^frame_.*\.png$"
DEFAULT_VIDEO_NAME = "processed_video.mp4"
DEFAULT_FPS = 24.0
VIDEO_CODECS = ["libx264", "libx265"]
CRF_RANGE = (0, 51)
SIDE_RANGE = (1, 16384)
OUTPUT_ROOTS = ["comfyui/output", "output"]

# Blurred background.
BLUR_SIGMA_PER_PIXEL = 0.006
BLUR_DIMMING = 0.35
