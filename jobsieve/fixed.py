"""Fixed values.

Every word list, lookup table, pattern and limit below is part of the expected
results: changing one changes the output.  They are stated as plain text and
are used as defaults; the operators take rule tables as arguments.
"""

# ---------------------------------------------------------------------------
# Sentinels for "no headcount".  The lists differ per call site on purpose.
# ---------------------------------------------------------------------------
NOT_AVAILABLE = "N/A"
SIZE_UNSPECIFIED = ("", "n/a", "unknown", "none", "null", "not specified")  # size gate, any case
SIZE_NOT_SMALL = ("N/A", "Unknown", "", "None")  # under-100 test, exact case
SIZE_MISSING_STAT = ("N/A", "Unknown", "", "None")  # run statistics
SIZE_TO_ENRICH = ("N/A", "", "None")  # profile lookup
PROFILE_SIZE_UNSPECIFIED = ("not specified", "unknown", "n/a", "none")  # profile text
STORED_LABEL_EMPTY = ("Unknown", "N/A", "")  # stored age label

# ---------------------------------------------------------------------------
# Text cleaning
# ---------------------------------------------------------------------------
EDGE_PUNCTUATION = "\"'’` -–—|·•/\\:;,"

KNOWN_LOCATIONS = (
    "usa", "us", "united states", "u.s.", "u.s.a.", "uk", "united kingdom", "u.k.", "canada",
    "germany", "france", "india", "australia", "europe", "emea", "apac", "americas", "worldwide",
    "remote", "global", "anywhere", "latam", "spain", "italy", "netherlands", "brazil", "mexico",
    "philippines", "singapore", "ireland", "poland", "japan", "china", "northern america",
    "north america", "south america", "european timezones", "cst timezone", "est timezone",
    "pst timezone",
)

COMPANY_AFFIXES = (
    "corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited", "technologies",
    "technology", "tech", "systems", "solutions", "data", "software", "digital", "labs", "media",
    "group", "studio", "studios", "health", "wellness", "consulting", "partners", "capital",
    "ventures", "interactive", "network",
)

LOCATION_WORDS = (
    "remote", "worldwide", "global", "anywhere", "usa", "us", "uk", "canada", "europe", "european",
    "emea", "latam", "apac", "asia", "asian", "africa", "african", "timezone", "timezones", "cst",
    "est", "pst", "cet", "gmt", "utc", "france", "germany", "spain", "italy", "india", "australia",
    "mexico", "brazil", "ireland", "netherlands", "poland", "philippines", "singapore", "america",
    "northern", "southern", "eastern", "western",
)

DATE_WORDS = r"posted|ago|today|yesterday|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d{4}"
SALARY_MARKS = r"\$|€|£|usd|eur|gbp"
SALARY_WORDS = r"k|yr|year|hour|hr|month|mo"
JOB_TYPE_WORDS = (
    r"full[- ]?time|part[- ]?time|contract|contractor|freelance|internship|temporary"
    r"|entry[- ]?level"
)
DESCRIPTION_STARTERS = (
    r"looking for|we are looking for|we are hiring|who we'?re looking for|who we are|are you a"
    r"|are you looking|join our|about us|about the role|the ideal candidate|company description"
    r"|role:|a day in the life|in this role|as a|our organization is seeking|overview:"
)
DESCRIPTION_LENGTH = 120

UI_ACTIONS = (
    "apply", "apply now", "quick apply", "easy apply", "view job", "read more", "search", "submit",
    "details", "share", "more info", "click here", "learn more",
)

COMPANY_LENGTH = (2, 80)
ROLE_LENGTH = (2, 120)
HEDGES = r"approx|about|around|estimate|unknown"
METADATA_DELIMITERS = "[·•|/\\-–—]"

# ---------------------------------------------------------------------------
# Headcount
# ---------------------------------------------------------------------------
HEADCOUNT_TIERS = {
    1: "1 - 10 employees",
    10: "10 - 50 employees",
    50: "50 - 200 employees",
    200: "200 - 500 employees",
    500: "500 - 1000 employees",
    1000: "More than 1000 employees",
}
MORE_THAN_PATTERN = (
    r"(?:more than|over|>)\s*([0-9,]+)\s*(?:employees|people|staff)?"
    r"|([0-9,]+)\+\s*(?:employees|people|staff)?"
)
RANGE_PATTERN = (
    r"([0-9,]+)\s*(?:[-–—]|to)\s*([0-9,]+)\s*(?:employees|people|staff|members)?"
)
LABEL_BEFORE_PATTERN = (
    r"(?:employees|headcount|team\s*size|company\s*size|staff|people|workforce)\s*[:\-–]?\s*"
    r"([0-9,]+(?:\.\d+)?\s*[kmbKMB]?)(?:\s*(?:employees|people|staff|members))?"
)
LABEL_AFTER_PATTERN = (
    r"([0-9,]+(?:\.\d+)?\s*[kmbKMB]?)\s+(?:employees|people|staff|team\s*members|workers)"
)
PURE_NUMBER_PATTERN = r"^\s*([0-9,]+(?:\.\d+)?\s*[kmbKMB]?)\s*$"
SMALL_COMPANY = 100

SIZE_BUCKETS = {
    "Small (1-50)": ("1 - 10", "10 - 50"),
    "Medium (50-500)": ("50 - 200", "200 - 500"),
    "Large (500+)": ("500 - 1000", "1000"),
}
LARGE_SIZE_PHRASE = "more than"  # any case, also Large

# ---------------------------------------------------------------------------
# Sources, feeds and crawling
# ---------------------------------------------------------------------------
FEED_A_SOURCE = "himalayas"
FEED_B_SOURCE = "instahyre"
FEED_PAGE_SIZE = 20
FEED_B_QUERY_DEFAULTS = {"isLandingPage": "true", "job_type": "0", "limit": "20"}
FEED_B_INDUSTRY = "13"
FEED_B_COMPANY_SIZE = "0"
FEED_B_DATE_KEYS = (
    "posted_at", "posted_on", "posted_date", "published_at", "published_on", "publish_date",
    "date_posted", "created_at", "created_on", "created_date",
)
FEED_B_LOCATION_KEYS = ("locations", "location", "city", "cities", "job_locations")
FEED_B_EMPLOYER_LOCATION_KEYS = ("locations", "location", "city")
RESERVED_JOB_PATHS = ("api", "search", "all")
MILLISECOND_CUTOVER = 100_000_000_000

ENGINEERING_PARENTS = ("developer", "engineering", "software engineering")
ENGINEERING_TERMS = (
    "engineer", "developer", "software", "backend", "frontend", "full stack", "full-stack",
    "devops", "sre", "programmer", "qa engineer", "test engineer", "technical architect",
)

CITY_ALIASES = {
    "bangalore": "Bangalore",
    "bengaluru": "Bangalore",
    "pune": "Pune",
    "hyderabad": "Hyderabad",
    "mumbai": "Mumbai",
    "chennai": "Chennai",
    "delhi-ncr": "Delhi NCR",
    "delhi": "Delhi",
    "new-delhi": "New Delhi",
    "gurgaon": "Gurgaon",
    "gurugram": "Gurgaon",
    "noida": "Noida",
    "greater-noida": "Greater Noida",
    "work-from-home": "Work From Home",
    "remote": "Remote",
    "kolkata": "Kolkata",
    "ahmedabad": "Ahmedabad",
    "kochi": "Kochi",
    "coimbatore": "Coimbatore",
    "jaipur": "Jaipur",
    "indore": "Indore",
    "chandigarh": "Chandigarh",
}
CITY_AT_PATTERN = r"-at-[a-z0-9\-]+-([a-z\-]+)$"

NEXT_TEXT_PATTERN = (
    r"^(next(\s*([>›»]|page|\d+))?|[>›»]|continue|siguiente|suivant|weiter)$"
)
EMPTY_PAGES_STOP = 3
KNOWN_STREAK_STOP = 40
MAX_RECORDS = 100_000
MAX_PAGES = 1_000
RECENT_ROWS = 25
SYNC_BATCH = 100
BACKFILL_COMPANIES = 150

# Card selectors, tried in this order: (tag or None, ((attribute, test, text), ...)).
# "word" = one of the space-separated values equals text, "has" = value contains text.
CARD_SELECTORS = (
    (None, (("class", "word", "employer-block"),)),
    (None, (("class", "word", "employer-row"),)),
    (None, (("ng-repeat", "has", "opp"),)),
    (None, (("ng-repeat", "has", "job"),)),
    ("article", (("class", "word", "card"),)),
    ("article", (("class", "has", "job"),)),
    ("article", ()),
    (None, (("data-testid", "has", "job"),)),
    (None, (("class", "has", "job-card"),)),
    (None, (("class", "has", "jobCard"),)),
    (None, (("class", "has", "job_card"),)),
    (None, (("class", "has", "job-item"),)),
    (None, (("class", "has", "jobItem"),)),
    (None, (("class", "has", "job_item"),)),
    (None, (("class", "has", "job-listing"),)),
    (None, (("class", "has", "jobListing"),)),
    (None, (("class", "has", "job-post"),)),
    (None, (("class", "has", "vacancy"),)),
    (None, (("class", "has", "position-card"),)),
    ("li", (("class", "has", "job"),)),
    ("div", (("class", "has", "card"), ("class", "has", "job"))),
    ("tr", (("class", "word", "athing"),)),
    (None, (("class", "word", "athing"),)),
)
ROLE_TITLE_TAGS = ("h1", "h2", "h3", "h4", "h5")
ROLE_CLASSES = ("title", "role", "position")
ROLE_LINK_PATHS = ("/job/", "/position/", "/career/", "/vacancy/")
JOB_LINK_PATHS = ("/job/", "/position/", "/career/")
COMPOUND_CLASS_WORDS = ("employer-job-name",)
COMPOUND_CLASSES = ("job-name", "company-name")
COMPANY_CLASSES = ("company", "employer", "organization")
COMPANY_NAME_LINK_PATHS = ("/company/", "/employer/", "/organization/", "/org/")
COMPANY_LINK_PATHS = ("/company/", "/employer/", "/org/")
META_CLASSES = ("meta", "topline", "byline", "subtitle", "details", "info")
META_INNER_TAGS = ("strong", "b", "span", "a")
SECONDARY_CLASSES = ("company", "employer", "hiring", "org-name")
SECONDARY_SKIP_CLASSES = (
    "summary", "desc", "excerpt", "employee", "headcount", "size", "salary", "location", "cat",
)
HEADCOUNT_CLASSES = ("employee", "headcount", "team-size", "size")
HEADCOUNT_TEXT_LIMIT = 60
TABLE_ROLE_WORDS = ("role", "title", "position", "job")
TABLE_COMPANY_WORDS = ("company", "employer", "org")
TABLE_SIZE_WORDS = ("employee", "people", "headcount", "size")
HYDRATION_ROLE_KEYS = ("title", "jobtitle", "role", "position")
HYDRATION_COMPANY_KEYS = ("company", "companyname", "organization", "employer")
HYDRATION_SIZE_KEYS = (
    "employeecount", "employees", "teamsize", "headcount", "numberofemployees",
)

# ---------------------------------------------------------------------------
# Category rules: (category id, category name, [(keyword, [terms])])
# ---------------------------------------------------------------------------
CATEGORY_KEYWORDS = (
    ("qa_automation", "QA & Test Automation", (
        ("QA & SDET", ("qa", "sdet", "quality assurance", "test engineer", "testing",
                       "automation engineer", "qa analyst", "qa engineer", "qa lead")),
        ("Selenium", ("selenium",)),
        ("Playwright", ("playwright",)),
        ("Cypress", ("cypress",)),
        ("Appium", ("appium",)),
        ("WebDriverIO", ("webdriverio", "webdriver.io", "webdriver io")),
        ("Rest Assured", ("rest assured", "restassured", "rest-assured")),
    )),
    ("devops_cloud", "DevOps & Cloud Infrastructure", (
        ("DevOps & SRE", ("devops", "sre", "site reliability", "cloud", "infrastructure",
                          "sysadmin", "system administrator", "aws", "azure", "gcp")),
        ("Kubernetes", ("kubernetes", "k8s")),
        ("Terraform", ("terraform",)),
    )),
    ("frontend_mobile", "Frontend & Mobile Development", (
        ("Frontend", ("frontend", "front-end", "front end", "ui engineer", "web developer")),
        ("React", ("react", "react.js", "reactjs")),
        ("iOS", ("ios", "swift", "objective-c")),
        ("Angular", ("angular", "angularjs")),
        ("React Native", ("react native", "react-native")),
        ("Android", ("android", "kotlin")),
        ("Flutter", ("flutter", "dart")),
        ("Vue", ("vue", "vue.js", "vuejs")),
        ("Svelte", ("svelte", "sveltekit")),
    )),
    ("backend", "Backend Development", (
        ("Backend", ("backend", "back-end", "back end", "api engineer", "server engineer")),
        ("Java", ("java ", "java/", "java-", "java,", "java engineer", "java developer",
                  "spring boot", "springboot")),
        ("Node", ("node", "nodejs", "node.js", "express")),
        ("Golang", ("golang", "go developer", "go engineer", "go software")),
        ("Python", ("python", "django", "fastapi", "flask")),
        ("Rust", ("rust", "rustlang")),
    )),
    ("data_analytics", "Data Analytics", (
        ("Data Analyst", ("data analyst", "business intelligence", "bi analyst",
                          "analytics engineer", "data analytics", "data analysis", "tableau",
                          "power bi")),
    )),
    ("data_engineering", "Data Engineering", (
        ("Data Engineering", ("data engineer", "data engineering", "etl", "big data", "spark",
                              "hadoop", "databricks", "data pipeline")),
    )),
    ("ux_design", "UX & Product Design", (
        ("UX & UI Design", ("ux designer", "ui/ux", "product designer", "user experience",
                            "interaction design", "figma", "ui designer", "web designer")),
    )),
    ("fde", "Forward Deployed Engineering", (
        ("FDE & Solutions", ("forward deployed", "forward-deployed", "fde", "solutions engineer",
                             "deployment engineer", "solutions architect",
                             "integration engineer")),
    )),
)
CATEGORY_FILES = {
    "qa_automation": "QA_Automation_Jobs",
    "devops_cloud": "DevOps_Cloud_Jobs",
    "frontend_mobile": "Frontend_Mobile_Jobs",
    "backend": "Backend_Jobs",
    "data_analytics": "Data_Analytics_Jobs",
    "data_engineering": "Data_Engineering_Jobs",
    "ux_design": "UX_Design_Jobs",
    "fde": "FDE_Jobs",
}

# Role categories, first match wins: (category, terms)
ROLE_CATEGORIES = (
    ("SDE", ("sde", "software development engineer", "software developer", "software engineer",
             "sde-1", "sde-2", "sde1", "sde2", "member of technical staff", "mts")),
    ("Frontend", ("frontend", "front-end", "front end", "react", "angular", "vue", "ui developer",
                  "ui engineer", "javascript developer", "web developer")),
    ("Backend", ("backend", "back-end", "back end", "api developer", "server-side", "node.js",
                 "django", "flask", "spring", "golang developer", "rust developer",
                 "java developer", "python developer")),
    ("Full Stack", ("full stack", "fullstack", "full-stack", "mean stack", "mern stack",
                    "lamp stack")),
    ("DevOps", ("devops", "dev ops", "infrastructure", "sre", "site reliability",
                "platform engineer", "cloud engineer", "devsecops", "ci/cd", "kubernetes",
                "docker")),
    ("Data / ML", ("data scientist", "data engineer", "machine learning", "ml engineer",
                   "ai engineer", "data analyst", "analytics engineer", "nlp", "deep learning",
                   "computer vision")),
    ("Mobile", ("mobile", "android", "ios", "flutter", "react native", "swift", "kotlin")),
    ("QA / Testing", ("qa", "quality assurance", "test engineer", "sdet", "automation engineer",
                      "testing")),
    ("Security", ("security engineer", "cybersecurity", "appsec", "penetration", "infosec")),
    ("Management", ("engineering manager", "product manager", "tech lead", "team lead", "cto",
                    "vp of engineering", "director of engineering", "project manager",
                    "scrum master")),
)
OTHER_ROLE = "Other"

MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
