"""Extraction from free text as column expressions; every pattern is native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9+#.]+|[一-鿿]"

# What counts as a skill, a constraint, a contact and a category.
SKILLS = (
    r"\b(?:Python|Java|JavaScript|C\+\+|C#|Go|Rust|Swift|Kotlin|PHP|Ruby|Scala|TypeScript)\b",
    r"\b(?:React|Angular|Vue|Node\.?js|Express|Django|Flask|Spring|Laravel|Rails)\b",
    r"\b(?:AWS|Azure|GCP|Docker|Kubernetes|Jenkins|Git|GitHub|GitLab)\b",
    r"\b(?:SQL|PostgreSQL|MySQL|MongoDB|Redis|Elasticsearch|Cassandra)\b",
    r"\b(?:Machine Learning|ML|AI|Deep Learning|NLP|Computer Vision|TensorFlow|PyTorch|Scikit-learn)\b",
    r"\b(?:Data Science|Analytics|Pandas|NumPy|Matplotlib|Seaborn|Jupyter)\b",
    r"\b(?:DevOps|CI/CD|Microservices|REST|GraphQL|API|Web Services)\b",
    r"\b(?:Agile|Scrum|Kanban|TDD|BDD|Unit Testing|Integration Testing)\b",
    r"\b(?:Linux|Unix|Windows|macOS|Bash|Shell|PowerShell)\b",
    r"\b(?:HTML|CSS|SASS|LESS|Bootstrap|Tailwind|Material UI)\b",
)
# All of them in one pass: no name is a part of another one's at a word's border, so none hides another.
ANY_SKILL = r"(?i)\b(?:" + "|".join(p[len(r"\b(?:"):-len(r")\b")] for p in SKILLS) + r")\b"
WORK_AUTHORISATION = r"\b(us|united states) work authorization required\b|\bmust be authorized to work in the (us|united states)\b|\b(legally|lawfully) authorized to work\b|\b(work authorization)\b"
NO_SPONSORSHIP = r"\b(no\s+visa\s+sponsorship|without\s+sponsorship|unable\s+to\s+sponsor|sponsorship\s+not\s+available)\b"
REMOTE = r"\b(remote[-\s]?first|remote\s+friendly|open\s+to\s+remote|hybrid)\b"
ON_SITE = r"\b(on[-\s]?site\s+only|must\s+be\s+on[-\s]?site|no\s+remote|not\s+remote)\b"
LOCATED = r"\b(located in|based in|work in|onsite in|on[-\s]?site in)\s+([a-z\s,]+)\b"
# The first and the ninth have one group, which is what is reported for them.
CERTIFICATES = (
    (r"aws\s+certified\s+(solutions\s+architect|developer|sysops|devops\s+engineer)", 1),
    (r"pmp\b", 0),
    (r"prince2\b", 0),
    (r"cissp\b", 0),
    (r"security\+\b", 0),
    (r"network\+\b", 0),
    (r"ccna\b|ccnp\b", 0),
    (r"az-?900\b|dp-?900\b|ai-?900\b|az-?104\b|az-?305\b", 0),
    (r"gcp\s+professional\s+(architect|engineer)", 1),
    (r"ckad\b|cka\b|cks\b", 0),
    (r"\bcomptia\b\s*(?:a\+|network\+|security\+)", 0),
)
DEGREES = (
    ("doctorate", r"doctorate|phd|d\.phil|ph\.d"),
    ("master", r"master\b|m\.?sc\b|m\.?eng\b|ms\b|m\.s\."),
    ("bachelor", r"bachelor\b|b\.?sc\b|b\.?eng\b|bs\b|ba\b|b\.s\.|b\.a\."),
    ("associate", r"associate\b|a\.?a\.?|a\.?s\.?"),
)
YEARS = r"(minimum|required|at\s+least)\s+(\d{1,2})\s+years?\s+(of\s+)?(relevant|professional|industry|experience)"
YEARS_PLUS = r"(\d{1,2})\+\s+years"
CLEARANCES = (r"secret\s+clearance", r"top\s+secret", r"ts/sci", r"ts\s*/\s*sci", r"public\s+trust", r"dod\s+clearance")
LANGUAGES = ("english", "spanish", "mandarin", "japanese", "french", "german", "hindi", "portuguese", "korean", "arabic")
LICENCES = (
    r"bar\s+license|licensed\s+attorney",
    r"cpa\b",
    r"pe\b(\s+license)?|professional\s+engineer",
    r"medical\s+license|state\s+license\s+to\s+practice",
    r"nursing\s+license|rn\b|registered\s+nurse",
    r"pharmacist\s+license|law\s+license|teaching\s+credential",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONES = (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\(\d{3}\)\s*\d{3}[-.]?\d{4}")
CATEGORIES = (
    ("programming_languages", ("python", "java", "javascript", "c++", "c#", "go", "rust", "swift", "kotlin", "php", "ruby", "scala", "typescript")),
    ("frameworks", ("react", "angular", "vue", "node.js", "express", "django", "flask", "spring", "laravel", "rails", "tensorflow", "pytorch")),
    ("databases", ("sql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "cassandra", "oracle")),
    ("cloud_platforms", ("aws", "azure", "gcp", "google cloud", "amazon web services")),
    ("tools", ("docker", "kubernetes", "jenkins", "git", "github", "gitlab", "jira", "confluence", "slack", "figma", "photoshop")),
    ("methodologies", ("agile", "scrum", "kanban", "tdd", "bdd", "devops", "ci/cd")),
    ("soft_skills", ("leadership", "communication", "teamwork", "problem solving", "project management", "mentoring", "presentation")),
)
FIELDS = "software|backend|frontend|full.?stack|fullstack|devops|data|machine.?learning|ml|ai"
TITLES = (
    rf"\b(?:{FIELDS})\s+(?:engineer|developer|architect|scientist|analyst|specialist)\b",
    r"\b(?:product|project|program|engineering|technical)\s+(?:manager|lead|director)\b",
    r"\b(?:senior|junior|entry.?level|mid.?level|lead|principal|staff)\s+(?:engineer|developer|architect|scientist|analyst)\b",
    rf"\b(?:senior|junior|entry.?level|mid.?level|lead|principal|staff)\s+(?:{FIELDS})\s+(?:engineer|developer|architect|scientist|analyst)\b",
)
SINGLE_SALARIES = (
    r"\$(\d+)k",
    r"\$(\d{1,3}(?:,\d{3})*)",
    r"(\d+)k\s*(?:annual|yearly|per year|salary)",
    r"(\d+)\s*(?:thousand|k)\s*(?:annual|yearly|per year|salary|dollars)",
    r"salary\s*(?:of|is|:)?\s*\$?(\d+)k?",
)
SALARY_RANGE = r"(\d+)k?\s*(?:to|-)\s*(\d+)k?\s*(?:annual|yearly|per year)"
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
NO_TECHNOLOGY = ("Software", "Engineer", "Developer", "California", "United", "States")
TECHNOLOGY = ("js", "jsx", "ts", "py", "java", "go", "rust", "swift", "kotlin", "api", "sdk", "sql", "nosql", "db", "orm", "http", "https", "ui", "ux", "css", "html", "xml", "json", "yaml", "toml")
FRAMEWORKS = ("React", "Angular", "Vue", "Django", "Flask", "Express", "Spring")
PLACE_PATTERNS = (
    (r"\b(?:in|at|near|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),?\s*([A-Z]{2})?\b", 2),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),?\s*([A-Z]{2})\b", 2),
    (r"\b(?:in|at|near|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", 1),
)
STATES = ("California", "New York", "Texas", "Florida", "Illinois", "Pennsylvania", "Ohio", "Georgia", "North Carolina", "Michigan", "New Jersey", "Virginia", "Washington", "Arizona", "Massachusetts", "Tennessee", "Indiana", "Missouri", "Maryland", "Wisconsin")
CITIES = ("San Francisco", "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia", "San Antonio", "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville", "Fort Worth", "Columbus", "Charlotte", "Seattle", "Denver", "Boston", "El Paso")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def skills(text: Column) -> Column:
    """Sorted lower-case skills named in the text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_SKILL), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x))))


def constraints(text: Column, lowered: bool = False) -> dict[str, Column]:
    """The hard constraints of a posting, by name; ``lowered``: the text is in lower case and not null."""
    t = text if lowered else F.lower(F.coalesce(text, F.lit("")))
    certificates = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(g)) for p, g in CERTIFICATES])
    degree = None
    for name, pattern in DEGREES:
        hit = t.rlike(rf"(minimum|required)\s+({pattern})")
        degree = F.when(hit, name) if degree is None else degree.when(hit, name)
    years = F.nullif(F.regexp_extract(t, YEARS, 2), F.lit(""))
    plus = F.nullif(F.regexp_extract(t, YEARS_PLUS, 1), F.lit(""))
    clearance = None
    for pattern in CLEARANCES:
        hit = t.rlike(pattern)
        clearance = F.when(hit, pattern) if clearance is None else clearance.when(hit, pattern)
    fluent = lambda x: rf"(fluent|fluency|proficient|native|excellent)\s+in\s+{x}\b|{x}\s+(fluency|required)\b"
    pick = lambda pairs: F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in pairs]), lambda x: x.isNotNull())
    return {
        "requires_work_authorisation": t.rlike(WORK_AUTHORISATION),
        "no_sponsorship": t.rlike(NO_SPONSORSHIP),
        "remote_allowed": F.when(t.rlike(ON_SITE), False).when(t.rlike(REMOTE), True),
        "location_required": F.nullif(F.trim(F.regexp_extract(t, LOCATED, 2)), F.lit("")),
        "certifications": F.transform(F.array_distinct(certificates), lambda x: F.upper(x)),
        "min_degree": degree,
        "min_years": F.coalesce(years, plus).cast("int"),
        "clearance": clearance,
        "languages": pick([(x, fluent(x)) for x in LANGUAGES]),
        "licences": pick([(p, p) for p in LICENCES]),
    }


def emails(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in PHONES])


def titles(text: Column) -> Column:
    """Sorted lower-case job titles."""
    found = F.concat(*[F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(p), F.lit(0)) for p in TITLES])
    return F.array_sort(F.array_distinct(found))


def salaries(text: Column) -> Column:
    """Struct of the lowest and highest salary named, alone or as the end of a range; null fields when
    there is none. A value in thousands (a k in the match; a single one also if under 1000) is multiplied."""
    t = F.lower(F.coalesce(text, F.lit("")))
    values = []
    for p in SINGLE_SALARIES:
        whole = F.regexp_extract_all(t, F.lit(p), F.lit(0))
        number = F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"))
        values.append(F.zip_with(whole, number, lambda w, n: F.when(F.contains(w, F.lit("k")) | (n < 1000), F.try_multiply(n, F.lit(1000))).otherwise(n)))
    ranges = F.regexp_extract_all(t, F.lit(SALARY_RANGE), F.lit(0))
    for g in (1, 2):
        ends = F.regexp_extract_all(t, F.lit(SALARY_RANGE), F.lit(g))
        values.append(F.zip_with(ranges, ends, lambda w, x: F.try_multiply(x.try_cast("bigint"), F.when(F.contains(w, F.lit("k")), F.lit(1000)).otherwise(F.lit(1)))))
    found = F.filter(F.concat(*values), lambda x: x.isNotNull())
    return F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"))


def technical_terms(text: Column) -> Column:
    """Sorted capitalised terms that hold a word part of technology or name a framework."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CAPITALISED), F.lit(0))
    likely = lambda x: (F.lower(x).rlike("|".join(TECHNOLOGY)) | x.isin(*FRAMEWORKS)) & (F.length(x) > 2) & ~x.isin(*NO_TECHNOLOGY)
    return F.array_sort(F.array_distinct(F.filter(found, likely)))


def named_places(text: Column) -> Column:
    """Sorted places written as 'in City, ST', 'City, ST' or 'in Place'."""
    t = F.coalesce(text, F.lit(""))
    parts = []
    for p, groups in PLACE_PATTERNS:
        one = F.regexp_extract_all(t, F.lit(p), F.lit(1))
        two = F.regexp_extract_all(t, F.lit(p), F.lit(2)) if groups == 2 else F.transform(one, lambda x: F.lit(""))
        parts.append(F.zip_with(one, two, lambda a, b: F.when(F.coalesce(b, F.lit("")) != "", F.concat(a, F.lit(", "), b)).otherwise(a)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def places(text: Column) -> Column:
    """Sorted states and cities that the text contains, and Remote."""
    t = F.lower(F.coalesce(text, F.lit("")))
    named = F.filter(F.array(*[F.lit(x) for x in dict.fromkeys(STATES + CITIES)]), lambda x: F.contains(t, F.lower(x)))
    return F.array_sort(F.concat(named, F.when(t.rlike(r"\bremote\b"), F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))))


def category(skill: Column) -> Column:
    """The first category with a keyword inside the lower-case skill, else other."""
    s, out = F.lower(skill), None
    for name, words in CATEGORIES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(s, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def marketability(categories: Column, experience: Column, technical: Column, soft: Column) -> Column:
    return F.least(F.lit(100), F.least(5 * categories, F.lit(30)) + F.least(5 * experience, F.lit(25)) + F.least(3 * technical, F.lit(25)) + F.least(4 * soft, F.lit(20)))
