"""Constants, vocabularies and dimension values of the evidence model."""

from __future__ import annotations

# Fixed values of the model: scores, thresholds, limits.
PRIOR_ODDS = 1e-5
SELECTIVITY_FLOOR = 1e-6
GROUP_CAP = 8.0
DEFINITIONAL_GROUP_CAP = 20.0
ALPHA = 0.5
DEFAULT_UNIVERSE = 1_000_000
CONTRADICTION_LLR = 4.0
BANDS = ((0.95, "STRONG_EVIDENCE"), (0.80, "MODERATE_EVIDENCE"), (0.55, "LIMITED_EVIDENCE"), (0.20, "WEAK"))
LOWEST_BAND = "UNSUPPORTED"
MIN_INDEPENDENT_GROUPS = 2
MERGE_LOG_ODDS = 2.197
MAX_HOLDERS = 250
ABSENCE_LEAST, ABSENCE_EXPECTED_FACTOR, ABSENCE_FLOOR = 0.01, 1.5, -6.0
MAP_EDGES, INDICATORS, PAIRS_SHOWN, REJECTED_SHOWN, DEMOTED_SHOWN = 40, 120, 50, 50, 30

# Predicates and what they are.
PREDICATES = (
    "same_as", "shares_analytics_id", "shares_gravatar", "shares_cert", "shares_favicon", "co_hosted", "commit_email", "key_binding",
    "profile_binding", "registrant", "owner_domain", "manager_domain", "seller_of", "legal_name", "incorporated_in", "registered_address",
    "officer_of", "beneficial_owner_of", "parent_of", "employed_by", "operates", "timezone_hint", "contradicts",
)
RELATIONSHIPS = ("officer_of", "beneficial_owner_of", "parent_of", "employed_by")
ATTRIBUTES = ("incorporated_in", "registered_address", "timezone_hint")
CORROBORATIVE = ("timezone_hint", "co_hosted", "shares_favicon")
# Days in which evidence loses half its weight; None does not decay, predicates not named take the default.
HALF_LIVES = {
    "incorporated_in": None,
    "legal_name": None,
    "seller_of": 1095.0,
    "owner_domain": 1095.0,
    "manager_domain": 730.0,
    "officer_of": 1825.0,
    "beneficial_owner_of": 1825.0,
    "parent_of": 1825.0,
    "registrant": 730.0,
    "registered_address": 1460.0,
    "commit_email": 1095.0,
    "key_binding": 1460.0,
    "profile_binding": 730.0,
    "shares_analytics_id": 545.0,
    "shares_gravatar": 1095.0,
    "shares_cert": 365.0,
    "shares_favicon": 365.0,
    "co_hosted": 180.0,
    "timezone_hint": 365.0,
    "same_as": None,
}
DEFAULT_HALF_LIFE = 730.0
RELIABILITY = {"authoritative": 1.0, "strong": 0.85, "moderate": 0.65, "weak": 0.40, "uncertain": 0.20}

# Identifier kinds.
KINDS = (
    "domain", "ip", "asn", "email", "handle", "person_name", "org_name", "seller_id", "analytics_id", "lei", "cik", "company_number",
    "gravatar_hash", "service_id", "pgp_fpr", "ssh_fpr", "cert_sha256", "favicon_mmh3", "postal_address", "phone", "url",
)
CASE_INSENSITIVE = ("domain", "email", "handle", "seller_id", "analytics_id", "url", "gravatar_hash", "cert_sha256", "pgp_fpr", "ssh_fpr")
DOT_STRIPPED = ("domain", "email", "handle", "seller_id")
ENTITY_TYPES = {
    "org_name": "Company", "lei": "Company", "cik": "Company", "company_number": "Company", "seller_id": "Company",
    "person_name": "Person", "email": "Persona", "handle": "Persona", "gravatar_hash": "Persona", "pgp_fpr": "Persona", "ssh_fpr": "Persona",
}
TYPE_RANK = ("Unknown", "Persona", "Person", "Company")
PRIORITY = {
    "seller_id": 1, "lei": 1, "cik": 1, "company_number": 1, "analytics_id": 2, "gravatar_hash": 2, "pgp_fpr": 2, "ssh_fpr": 2, "domain": 2,
    "email": 3, "handle": 3, "org_name": 4, "person_name": 4,
}
DEFAULT_PRIORITY = 5
PIVOTABLE = ("domain", "org_name", "person_name", "seller_id", "analytics_id", "email", "handle", "lei", "company_number", "gravatar_hash", "cik")

# Dependence classes in the order in which their patterns are tried.
DEPENDENCE_PATTERNS = (
    ("site_setup", r"analytics|gtm|favicon|theme|header|artifacts\|.*\|(ga4|ua|gtm|fbpixel|hotjar|sentry|mixpanel|clarity|yandex)"),
    ("monetization_setup", r"ads_txt|app_ads|sellers_json|seller|adsense|publisher"),
    ("dns_hosting", r"dns|rdap_ns|crtsh|cert|internetdb|pdns|mx|co_hosted|ip"),
    ("registration", r"rdap|whois|registrant|registrar"),
    ("corporate_filing", r"gleif|edgar|companies_house|opencorporates|cninfo|officer|lei|acris|filing"),
    ("code_publication", r"git|github|gitlab|npm|pypi|crates|package|extension|app_store"),
    ("persona_naming", r"handle|persona|nickname|wp_users|display_name"),
)
DISCOUNTS = {
    "site_setup": 0.25, "monetization_setup": 0.30, "dns_hosting": 0.20, "registration": 0.15, "corporate_filing": 0.25,
    "code_publication": 0.40, "persona_naming": 0.20, "independent": 1.0, "unknown": 0.20,
}

# Collectors whose identity assertions are definitional.
DEFINITIONAL_COLLECTORS = (
    "gleif", "sec_edgar", "companies_house_uk", "cninfo_disclosure", "opencorporates", "rdap", "icij_offshore_leaks",
    "lookup_gleif", "lookup_companies_house", "lookup_rdap", "agent:lookup_gleif", "agent:lookup_companies_house", "agent:lookup_rdap",
)

# How much of its scope a source covers, and on what basis that is known.
COVERAGE = {
    "companies_house_uk": (0.98, "statutory"), "sec_edgar": (0.95, "statutory"), "gleif": (0.99, "published"),
    "reverse_publisher_id": (0.0, "estimated"), "business_directory": (0.0, "estimated"), "icij_offshore_leaks": (0.85, "estimated"),
    "cninfo_disclosure": (0.97, "statutory"), "dmca_agent": (0.80, "estimated"), "extension_store_developer": (0.95, "estimated"),
    "opencorporates": (0.75, "estimated"), "sellers_json": (0.90, "estimated"), "rdap": (0.99, "estimated"), "crtsh": (0.97, "estimated"),
    "wayback": (0.40, "estimated"),
}

# Filter vocabularies and patterns.
ROLE_ACCOUNTS = (
    "admin", "administrator", "abuse", "postmaster", "hostmaster", "webmaster", "noreply", "no-reply", "donotreply", "support", "info",
    "contact", "sales", "billing", "help", "security", "dns", "root", "office", "mail", "legal", "privacy", "dpo", "gdpr", "team", "hello",
    "service", "notifications",
)
PRIVACY_PROXY = (
    r"whoisguard|domains?\s*by\s*proxy|privacyprotect|withheld\s*for\s*privacy|redacted\s*for\s*privacy|contact\s*privacy|perfect\s*privacy|"
    r"private\s*by\s*design|identity\s*protect|super\s*privacy|domain\s*protection|namecheap\s*inc|data\s*protected|gdpr\s*masked|"
    r"not\s*disclosed|statutory\s*masking"
)
NOMINEE_AGENT = (
    r"\b(c\s*t\s*corporation|corporation\s*service\s*company|\bcsc\b|registered\s*agents?\s*inc|northwest\s*registered\s*agent|incfile|legalzoom|"
    r"harvard\s*business\s*services|cogency\s*global|vistra|trident\s*trust|company\s*secretar(?:y|ial)\s*(?:services|ltd)|nominee\s*director)\b"
)
HOSTING_ORG = r"cloudflare|akamai|fastly|amazon|aws|google\s*llc|microsoft|azure|digitalocean|linode|ovh|hetzner|vercel|netlify|godaddy|namecheap|hostinger"

# Characters that hide or imitate others.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
HOMOGLYPHS_FROM = "\u0430\u0435\u043e\u0440\u0441\u0445\u0443\u0456\u0455\u04bb\u0501\u051b\u0261\u04cf\u0458\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u0405\u0406\u0408\u03b1\u03bf\u03c1\u03c5\u03bd\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a7"
HOMOGLYPHS_TO = "aeopcxyishdqgljABEKMHOPCTXSIJaopuvABEZHIKMNOPTX"
PUNCTUATION_FROM = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uff0d\u2018\u2019\u201c\u201d\u00a0\u2007\u202f\u3000\uff0e\u3002\uff1a\uff0f"
PUNCTUATION_TO = "--------''\"\"    ..:/"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
DELIBERATE = ("bidi_control", "control_char", "homoglyph", "zero_width")

# Exports.
FTM_SCHEMA = {"Company": "Company", "Person": "Person", "Persona": "LegalEntity", "Unknown": "LegalEntity"}
FTM_PROPERTY = {
    "org_name": "name", "person_name": "name", "email": "email", "domain": "website", "lei": "leiCode",
    "company_number": "registrationNumber", "postal_address": "address", "phone": "phone",
}
INDICATOR_LABELS = {
    "domain": "domain", "ip": "ipv4-addr", "email": "email-addr", "analytics_id": "analytics-id", "seller_id": "adtech-seller-id",
    "service_id": "service-id", "gravatar_hash": "gravatar-md5", "cert_sha256": "x509-sha256", "favicon_mmh3": "favicon-mmh3",
    "pgp_fpr": "pgp-fingerprint", "ssh_fpr": "ssh-fingerprint", "asn": "asn", "url": "url", "handle": "user-account",
}
SELF_PUBLISHED = ("imprint", "dns_txt", "ownerdomain", "surface")
