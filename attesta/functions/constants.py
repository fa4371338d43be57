"""Fixed values that results depend on."""

# Words without weight in titles, interchangeable role words, countries that disprove a location.
TITLE_NOISE = [
    "a", "an", "the", "at", "of", "and", "or", "in", "for", "to", "with",
    "sr", "snr", "senior", "jr", "junior", "lead", "principal", "staff",
    "i", "ii", "iii", "iv", "l1", "l2", "l3", "l4", "l5",
]
ROLE_WORDS = ["Engineer", "Developer", "Programmer", "SDE"]
FOREIGN = [
    "indonesia", "pakistan", "bangladesh", "srilanka", "nepal", "singapore",
    "malaysia", "philippines", "vietnam", "thailand", "unitedstates", "usa",
    "unitedkingdom", "uk", "canada", "australia", "germany", "netherlands",
    "ireland", "uae", "unitedarabemirates", "dubai", "qatar", "saudiarabia",
    "poland", "brazil", "mexico", "nigeria", "kenya", "egypt", "turkey", "china",
    "japan", "southkorea", "france", "spain", "italy", "sweden", "switzerland",
]

# The components that may be scored, and signals that no claim may name.
COMPONENTS = ["skill_match", "skill_depth", "seniority_fit", "activity_recency", "availability"]
BANNED = [
    "college_name", "college_tier", "graduation_year", "age", "name_tokens", "photo", "photograph", "date_of_birth",
    "dob", "gender", "caste", "religion", "marital_status", "nationality", "current_employer_prestige",
]

# Scoring.
TIERS = ["artifact_backed", "third_party_stated", "self_reported"]
NICE_WEIGHT = 0.4
NONE_HELD_FACTOR = 0.25
DEPTH_CAP = 500_000.0
HALF_LIFE_DAYS = 365.0
SENIORITY_SLACK_YEARS = 4.0
DECIMALS = 6
SCORER_VERSION = "scoring@2"
WEIGHTS = dict.fromkeys(COMPONENTS, 0.2)
LABELS = [(0.55, "Strong match"), (0.40, "Good match"), (0.25, "Possible match")]

# Months and the vocabulary of line layouts.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SECTION_ENDS = ["more profiles for you", "people also viewed", "people you may know", "explore premium profiles"]
EMPLOYMENT_TYPES = [
    "full-time", "part-time", "self-employed", "freelance", "contract",
    "internship", "apprenticeship", "seasonal", "temporary", "permanent",
]
ACTIONS = ["shortlisted", "rejected", "contacted", "needs_info"]

# Patterns of texts and layouts.
ROLE_WORD = r"(?i)\b(engineer|developer|programmer|sde)s?\b"
YEARS_RANGE = r"(?i)(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s*\+?\s*years?"
YEARS_LEAST = r"(?i)(?:at least|minimum(?: of)?|min\.?)\s*(\d{1,2})\s*\+?\s*years?"
YEARS_PLUS = r"(?i)(\d{1,2})\s*\+\s*years?"
DATED_LINE = r"^([A-Za-z]{3,9}\.?\s+\d{4}|\d{4})\s*[-–—]\s*(Present|Current|[A-Za-z]{3,9}\.?\s+\d{4}|\d{4})\b"
TENURE_LINE = r"(?i)^\d+\s*(?:yrs?|mos?)(?:\s+\d+\s*(?:yrs?|mos?))?$"
NO_EMPLOYER_STARTS = ["●", "•", "-", "skills:", "… more", "...more", "show "]
NO_SKILL_LINES = ["skills", "all", "industry knowledge", "tools & technologies", "show all"]
JUNIOR_WORDS = ["intern", "student", "trainee", "fresher", "junior", "jr ", "jr.", "apprentice", "graduate"]

# Addresses.
SECRET_PARAMS = ["api_key", "apikey", "key", "token", "access_token", "secret"]
PERSON_MARKERS = ["in", "pub"]
NO_PERSON_SEGMENTS = [
    "company", "school", "jobs", "pulse", "posts", "groups", "showcase",
    "learning", "events", "feed", "help", "legal", "directory", "checkpoint",
]
LINKS = {
    "github_login": "https://github.com/%s",
    "gitlab_login": "https://gitlab.com/%s",
    "linkedin_slug": "https://linkedin.com/in/%s",
    "personal_domain": "https://%s",
    "hf_user": "https://huggingface.co/%s",
    "codeforces_handle": "https://codeforces.com/profile/%s",
}
STRONG_KINDS = ["github_login", "gitlab_login", "hf_user", "codeforces_handle", "so_user_id", "personal_domain", "email_sha256", "linkedin_slug"]
LOGIN_KEYS = ["github_url", "url", "blog"]
# Words that make a title, and words that identify no employer.
TITLE_CUES = [
    "manager", "director", "head", "lead", "leader", "vp", "svp", "avp", "president",
    "chief", "officer", "ceo", "cto", "coo", "cfo", "cmo", "chro", "founder",
    "cofounder", "partner", "principal", "associate", "analyst", "consultant",
    "strategist", "specialist", "coordinator", "executive", "engineer", "developer",
    "designer", "architect", "scientist", "researcher", "advisor", "counsel",
    "controller", "treasurer", "recruiter", "generalist",
]
EMPLOYER_STOP = [
    "private", "limited", "ltd", "pvt", "inc", "incorporated", "llc", "llp", "plc",
    "corp", "corporation", "company", "co", "group", "holdings", "ventures",
    "technologies", "technology", "tech", "solutions", "systems", "services",
    "software", "labs", "consulting", "consultants", "partners", "global",
    "international", "india", "asia", "digital", "media", "online", "the", "and",
    "fulltime", "full", "time", "parttime", "part", "contract", "freelance",
    "internship", "intern", "permanent", "temporary", "selfemployed", "self",
    "employed", "apprenticeship", "seasonal",
]
TITLE_AFTER = r"\s*[,:|\-–—]\s*([A-Za-z][A-Za-z&/'. ]{2,80})"
# Dated ranges of a page's text, the walls that its fields tell, and all walls.
DATED_RANGE = r"(?iU)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{4}\s*[-–—]\s*(?:Present|[A-Z][a-z]{2}\w*\.?\s+\d{4})"
PAGE_WALLS = ["join linkedin", "authwall", "sign in to see"]
WALLS = ["authwall", "Join LinkedIn", "Sign in to see", "Please verify you are a human"]

# Search plans, roles and the queue.
COUNTRY = "India"
PLAN_CAP = 24
RESULTS_CAP = 20
RESCUE_BELOW = 0.5
MUST_HAVES = 6
REMOTE = ["onsite", "hybrid", "remote", "remote_relocate"]
PROFILES = {True: "engineering", False: "business"}
NOTE_CHARS = 500
PHRASES = {
    "no evidence for": "No public sign of",
    "outside": "Located outside",
    "most recent public work": "Most recent public work is",
}
STAGES = {"discover": "Searching LinkedIn", "enrich": "Reading profiles", "score": "Ranking"}
