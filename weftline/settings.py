"""Constants of the fusion model."""

# Sources in the order in which their records appear, and the trust in each.
SOURCES = ["recruiter_csv", "ats_json", "github", "recruiter_notes"]
SOURCE_TRUST = {"recruiter_csv": 0.80, "ats_json": 0.90, "github": 0.70, "recruiter_notes": 0.55}
# Trust in the way a value was obtained.
METHOD_TRUST = {"direct": 1.0, "regex": 0.7, "inferred": 0.5}
# Fusion of conflicting values.
THRESHOLD, CONFLICT_STEP, CONFLICT_FLOOR = 0.70, 0.15, 0.30
# Weight of each family in the overall confidence, in the order in which they are summed.
FAMILY_WEIGHTS = {
    "full_name": 0.18,
    "emails": 0.22,
    "phones": 0.15,
    "location": 0.08,
    "links": 0.04,
    "headline": 0.03,
    "years_experience": 0.02,
    "skills": 0.10,
    "experience": 0.12,
    "education": 0.05,
    "projects": 0.01,
}
# Words that end a company's name without telling it apart.
COMPANY_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company"]

SINGLES = ["full_name", "location", "headline", "years_experience"]
MULTIS = ["emails", "phones", "skills"]
LINKS = ["linkedin", "github", "portfolio"]
ENTRIES = {
    "experience": ["company", "title", "start", "end", "summary"],
    "education": ["institution", "degree", "field", "end_year"],
    "projects": ["name", "description", "url", "primary_language"],
}
