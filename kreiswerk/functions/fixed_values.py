"""Lists and constants that decide results and must stay as they are."""

# Lead-ins removed from the start of titles and descriptions, tried in this order.
BOILERPLATE_PREFIXES = (
    "about this event",
    "please join us for",
    "join us for",
    "you're invited to",
    "save the date:",
)

# Parts of German street names.
STREET_TOKENS = ("strasse", "straße", "str.", "weg", "allee", "platz", "gasse", "ring", "damm")

# Keyword -> topic tag.
KEYWORD_TO_TAG = {
    "ai": "ai",
    "ki": "ai",
    "machine learning": "ai",
    "ml": "ai",
    "llm": "ai",
    "genai": "ai",
    "kubernetes": "cloud",
    "k8s": "cloud",
    "cloud native": "cloud",
    "docker": "cloud",
    "container": "cloud",
    "java": "java",
    "jvm": "java",
    "spring": "java",
    "kotlin": "java",
    ".net": "dotnet",
    "dotnet": "dotnet",
    "c#": "dotnet",
    "csharp": "dotnet",
    "azure": "dotnet",
    "javascript": "frontend",
    "typescript": "frontend",
    "react": "frontend",
    "vue": "frontend",
    "angular": "frontend",
    "frontend": "frontend",
    "python": "data",
    "data science": "data",
    "datenanalyse": "data",
    "analytics": "data",
    "data engineering": "data",
    "security": "security",
    "sicherheit": "security",
    "owasp": "security",
    "pentest": "security",
    "hacking": "security",
    "devops": "devops",
    "sre": "devops",
    "platform engineering": "devops",
    "ci-cd": "devops",
    "rust": "systems",
    "c++": "systems",
    "cpp": "systems",
    "golang": "systems",
    "agile": "practice",
    "scrum": "practice",
    "kanban": "practice",
    "craft": "practice",
    "architektur": "practice",
    "architecture": "practice",
    "ux": "design",
    "ui": "design",
    "design": "design",
    "usability": "design",
    "iot": "hardware",
    "embedded": "hardware",
    "robotik": "hardware",
    "robotics": "hardware",
    "hardware": "hardware",
    "open source": "opensource",
    "opensource": "opensource",
    "linux": "opensource",
    "hackergarten": "opensource",
}

# GeoNames first-level division code of Germany -> state abbreviation.
GERMAN_STATES = {
    "01": "BW",
    "02": "BY",
    "03": "HB",
    "04": "HH",
    "05": "HE",
    "06": "NI",
    "07": "NW",
    "08": "RP",
    "09": "SL",
    "10": "SH",
    "11": "BB",
    "12": "MV",
    "13": "SN",
    "14": "ST",
    "15": "TH",
    "16": "BE",
}

# Schema.org attendance mode and page event type -> attendance.
ATTENDANCE_BY_MODE = {
    "https://schema.org/OfflineEventAttendanceMode": "InPerson",
    "https://schema.org/OnlineEventAttendanceMode": "Online",
    "https://schema.org/MixedEventAttendanceMode": "Hybrid",
}
ATTENDANCE_BY_EVENT_TYPE = {"PHYSICAL": "InPerson", "ONLINE": "Online", "HYBRID": "Hybrid"}
ATTENDANCES = ("InPerson", "Online", "Hybrid")

# Mean earth radius, country box accepted for geocoder answers, request limits.
EARTH_RADIUS_KM = 6371.0088
GERMANY_LAT = (47.2, 55.1)
GERMANY_LON = (5.8, 15.1)
GERMANY_NAME = "Deutschland"
MAX_RADIUS_KM = 500.0
MAX_PAGE = 500
DEFAULT_PAGE = 100

# Gazetteer rules.
MIN_ALIAS_LENGTH = 4
MAX_ALIASES = 5

# Zone names that desktop calendars write, and the zone ids they stand for.
DESKTOP_ZONES = {
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "Alaskan Standard Time": "America/Anchorage",
    "Pacific Standard Time": "America/Los_Angeles",
    "US Mountain Standard Time": "America/Phoenix",
    "Mountain Standard Time": "America/Denver",
    "Central Standard Time": "America/Chicago",
    "Central Standard Time (Mexico)": "America/Mexico_City",
    "Eastern Standard Time": "America/New_York",
    "SA Pacific Standard Time": "America/Bogota",
    "Atlantic Standard Time": "America/Halifax",
    "Pacific SA Standard Time": "America/Santiago",
    "Newfoundland Standard Time": "America/St_Johns",
    "E. South America Standard Time": "America/Sao_Paulo",
    "Argentina Standard Time": "America/Buenos_Aires",
    "Azores Standard Time": "Atlantic/Azores",
    "GMT Standard Time": "Europe/London",
    "Greenwich Standard Time": "Atlantic/Reykjavik",
    "Morocco Standard Time": "Africa/Casablanca",
    "W. Europe Standard Time": "Europe/Berlin",
    "Central Europe Standard Time": "Europe/Budapest",
    "Romance Standard Time": "Europe/Paris",
    "Central European Standard Time": "Europe/Warsaw",
    "W. Central Africa Standard Time": "Africa/Lagos",
    "GTB Standard Time": "Europe/Bucharest",
    "E. Europe Standard Time": "Europe/Chisinau",
    "FLE Standard Time": "Europe/Kiev",
    "Egypt Standard Time": "Africa/Cairo",
    "South Africa Standard Time": "Africa/Johannesburg",
    "Israel Standard Time": "Asia/Jerusalem",
    "Turkey Standard Time": "Europe/Istanbul",
    "Belarus Standard Time": "Europe/Minsk",
    "Russian Standard Time": "Europe/Moscow",
    "Arab Standard Time": "Asia/Riyadh",
    "E. Africa Standard Time": "Africa/Nairobi",
    "Iran Standard Time": "Asia/Tehran",
    "Arabian Standard Time": "Asia/Dubai",
    "Pakistan Standard Time": "Asia/Karachi",
    "India Standard Time": "Asia/Calcutta",
    "Bangladesh Standard Time": "Asia/Dhaka",
    "SE Asia Standard Time": "Asia/Bangkok",
    "China Standard Time": "Asia/Shanghai",
    "Singapore Standard Time": "Asia/Singapore",
    "W. Australia Standard Time": "Australia/Perth",
    "Taipei Standard Time": "Asia/Taipei",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Korea Standard Time": "Asia/Seoul",
    "AUS Central Standard Time": "Australia/Darwin",
    "AUS Eastern Standard Time": "Australia/Sydney",
    "E. Australia Standard Time": "Australia/Brisbane",
    "New Zealand Standard Time": "Pacific/Auckland",
}
