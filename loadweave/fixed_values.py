"""Values that results depend on and that are given, not chosen here."""

# --- fixed values -----------------------------------------------------------
FILE_TYPES = ("orders", "fleet", "drivers", "gps", "other")

# single-file form slots with the file type each stands for, then the list slot
SINGLE_SLOTS = (
    ("orders_file", "orders"),
    ("fleet_file", "fleet"),
    ("drivers_file", "drivers"),
    ("gps_file", "gps"),
)
LIST_SLOT = ("other_files", "other")

SCENARIOS = ("توزیع روزانه", "توزیع بین‌شهری", "توزیع فوری")

DEFAULT_STATUS = "SUBMITTED"
UPLOAD_FOLDER = "uploads"
STATUS_CLASS_PREFIX = "status-"
RUN_SUCCESS = "success"
STATUS_REFRESH = "30 seconds"

KPI_FALLBACK = {"projects": 12, "companies": 8, "orders": 1540, "vehicles": 47}

# longest value, in characters, per declared text column
REQUEST_LIMITS = {
    "company_name": 200,
    "contact_name": 200,
    "mobile": 30,
    "email": 200,
    "industry": 100,
    "status": 30,
}
FILE_LIMITS = {
    "file_type": 30,
    "original_name": 255,
    "stored_name": 255,
    "file_path": 500,
    "content_type": 100,
}
COMPANY_LIMITS = {"name": 255, "code": 50}
# ----------------------------------------------------------------------------
