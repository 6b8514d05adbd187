"""Word lists and patterns that extraction results depend on."""

from __future__ import annotations

# Results must equal the established ones, so these lists, their order and the patterns stay as they are.
CS_KEYWORDS = (
    "software engineer", "backend engineer", "frontend engineer", "full stack", "fullstack", "data engineer", "ml engineer",
    "machine learning", "devops", "data scientist", "python developer", "java developer", "android developer", "ios developer",
    "cloud engineer", "site reliability", "sre", "platform engineer", "security engineer", "systems engineer",
    "infrastructure engineer", "backend", "frontend", "mobile engineer",
)
SKILLS = (
    "python", "java", "javascript", "typescript", "golang", "rust", "c++", "c#", "ruby", "swift", "kotlin", "scala", "php", "bash",
    "r", "matlab", "react", "angular", "vue", "next.js", "svelte", "html", "css", "tailwind", "redux", "node.js", "express", "django",
    "flask", "fastapi", "spring", "rails", "laravel", "aws", "gcp", "azure", "docker", "kubernetes", "terraform", "ansible",
    "jenkins", "github actions", "ci/cd", "linux", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "cassandra",
    "dynamodb", "snowflake", "databricks", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy", "spark", "kafka", "airflow",
    "dbt", "machine learning", "deep learning", "nlp", "computer vision", "rest", "graphql", "grpc", "microservices", "rabbitmq",
    "git", "agile", "system design", "data structures", "algorithms",
)
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ "
    "NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
SECTIONS = {
    "responsibilities": (
        "key responsibilities", "responsibilities", "what you.?ll do", "what you will do", "what you will", "you will", "your role",
        "job duties", "duties", "in this role", "what you.?ll be doing", "position purpose", "the opportunity", "your day.to.day",
        "about the role",
    ),
    "qualifications": (
        "qualifications", "requirements", "what you.?ll need", "what we.?re looking for", "required skills", "minimum qualifications",
        "basic qualifications", "preferred qualifications", "you have", "you.?ll have", "you must have", "must have", "experience",
        "tech stack", "technical skills", "skills", "what you bring", "what we need",
    ),
    "benefits": (
        "benefits", "what we offer", "perks", "what you.?ll get", "we offer", "compensation and benefits", "total compensation",
        "why join", "our offer", "what.s in it for you",
    ),
}
VISA_YES = ("visa sponsorship", "will sponsor", "we sponsor", "h1b sponsor", "h-1b sponsor", "sponsorship available", "open to sponsoring", "sponsorship provided")
VISA_NO = (
    "no visa", "cannot sponsor", "not able to sponsor", "unable to sponsor", "no sponsorship", "sponsorship not available",
    "must be authorized", "must be legally authorized", "not eligible to sponsor", "us citizen", "green card only", "no h1b",
)
REMOTE = r"100\s*%\s*remote|fully remote|entirely remote|work from anywhere"
ONSITE = (
    r"this is an?\s+on.?site role",
    r"on.?site role\s+based in",
    r"required to (?:work |be )?on.?site",
    r"must (?:work |be )?(?:in.?office|on.?site)",
)
# The word ends that these had are spelled out where they are used.
HYBRID = (
    r"hybrid work (?:environment|schedule|model|arrangement|options?)(?:[^\p{L}\p{N}_]|$)",
    r"hybrid working (?:environment|schedule|model|arrangement)",
    r"considered hybrid",
    r"hybrid remote telecommut",
    r"hybrid (?:position|role)(?:[^\p{L}\p{N}_]|$)",
    r"(?:remote or hybrid|hybrid or remote) role",
    r"this position can be (?:set up as )?(?:either\s+)?(?:a\s+)?(?:remote or )?hybrid",
    r"\d+[\s\-–]+\d+\s+days?\s+(?:per week\s+)?in\s+(?:the\s+)?office",
    r"\d+\s+days?\s+(?:per week\s+)?(?:in\s+(?:the\s+)?office|on.?site)",
)
INTERN = r"intern(ship)?|co-?op"
SENIOR = r"senior|sr\.?|staff|principal|lead|manager|director|vp|head of"
ENTRY = r"junior|jr\.?|entry.level|associate|new.?grad|graduate"
SEASONS = "summer|fall|spring|winter"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SEASON_NOUNS = "internship|position|semester|cohort|program|co-op|batch"
BOILERPLATE = (
    r"equal (employment )?opportunity|affirmative action|do(es)? not discriminate|without regard to (race|sex|age|religion)|"
    r"reasonable accommodation|accommodations? (for|to) (applicants|individuals|candidates) with disabilit|background checks?|"
    r"arrest (and|or) conviction|export[- ]control|e-verify|(applicant|candidate) privacy|privacy (notice|policy)|non-compliant|"
    r"malicious actors|recruit(ment|ing) (fraud|scams?)"
)
LEVER_TYPES = {"full-time": "FULLTIME", "part-time": "PARTTIME", "internship": "INTERN", "intern": "INTERN", "contract": "CONTRACTOR", "temporary": "CONTRACTOR"}
CLIP = {"title": 255, "company": 255, "source": 100, "source_job_id": 255, "city": 100, "state": 100, "country": 100, "work_mode": 20, "job_type": 50, "experience_level": 20, "salary_currency": 10, "salary_period": 20, "start_date_text": 100}
# End of fixed values.

#: A word's edge on either side, whatever the script and the regex engine.
WORD = r"[\p{L}\p{N}_]"
EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def whole_words(alternatives: str) -> str:
    return f"{EDGE_BEFORE}(?:{alternatives}){EDGE_AFTER}"


def quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def skill_pattern(skill: str) -> str:
    """The skill between two word edges; one that ends in a mark has an edge only before a letter."""
    after = EDGE_AFTER if skill[-1].isalnum() else WORD
    return f"{EDGE_BEFORE}{quoted(skill)}{after}"


# How answers cite, in their own form and in brackets of other scripts, and how they abstain.
CITED = r"\[(\d+(?:\s*,\s*\d+)*)\]"
FOREIGN_CITED = r"[【［]\s*(\d+(?:\s*[,，]\s*\d+)*)[^】］\n]*[】］]"
WIDE_COMMA_CITED = r"(?<=\d)\s*，\s*(?=\d[\d\s,，]*\])"
ABSTAIN = "INSUFFICIENT"
# End of fixed values.
