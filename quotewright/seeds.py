"""Reference data for the business rules, and the DataFrames built from it.

Every table here has a fixed number of rows that does not depend on the input
(31 industries, 89 and 119 aliases, 13 extra roles), so broadcasting one of
them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Rates in paise, percentages as whole numbers, tiers, labels.
# --------------------------------------------------------------------------
DEV_RATE_PAISE = 15_000_000  # 150 000 INR a month
DEFAULT_CONTINGENCY_PCT = 10
DEFAULT_REASON = "Standard technology project"
UNRESOLVED_LABEL = "general"
CURRENCY = "INR"
USER_TIERS = ((1_000, 4_200), (10_000, 2_900))  # (users up to, paise per user)
TOP_TIER_PAISE = 1_700

# --------------------------------------------------------------------------
# Development %, infrastructure %, contingency % per industry.
# --------------------------------------------------------------------------
_PERCENTAGES = (
    ("healthcare", 135, 125, 15),
    ("finance", 140, 130, 15),
    ("fintech", 135, 125, 15),
    ("insurance", 130, 120, 15),
    ("pharmaceuticals", 140, 120, 15),
    ("ecommerce", 110, 130, 12),
    ("retail", 110, 115, 10),
    ("education", 100, 110, 10),
    ("manufacturing", 125, 120, 12),
    ("logistics", 115, 120, 12),
    ("real estate", 110, 110, 10),
    ("telecom", 130, 135, 15),
    ("energy", 125, 125, 15),
    ("automotive", 130, 120, 12),
    ("media", 110, 130, 10),
    ("gaming", 120, 135, 12),
    ("agriculture", 105, 110, 10),
    ("government", 120, 115, 15),
    ("hospitality", 105, 110, 10),
    ("construction", 115, 110, 12),
    ("legal", 120, 110, 12),
    ("hr", 100, 105, 10),
    ("nonprofit", 90, 100, 10),
    ("saas", 115, 120, 12),
    ("cloud", 115, 125, 12),
    ("cybersecurity", 135, 120, 15),
    ("travel", 110, 120, 12),
    ("food", 105, 115, 10),
    ("sports", 110, 120, 10),
    ("blockchain", 130, 115, 15),
    ("ai_ml", 130, 135, 15),
)


def _reason(dev: int, infra: int, contingency: int) -> str:
    return f"Development at {dev} %, infrastructure at {infra} %, contingency at {contingency} %"


MULTIPLIERS = tuple((*row, _reason(*row[1:])) for row in _PERCENTAGES)
INDUSTRIES = tuple(row[0] for row in MULTIPLIERS)

# --------------------------------------------------------------------------
# Pricing aliases. The order decides which containment match wins.
# --------------------------------------------------------------------------
_COST_ALIAS_GROUPS = (
    ("healthcare", "health, medical, hospital"),
    ("pharmaceuticals", "pharma, pharmaceutical, biotech"),
    ("finance", "banking, bank, financial"),
    ("insurance", "insurtech"),
    ("fintech", "payments, lending"),
    ("ecommerce", "e-commerce, ecom, online store, marketplace"),
    ("retail", "fmcg, consumer goods"),
    ("education", "edtech, university, school"),
    ("manufacturing", "factory, industrial"),
    ("logistics", "supply chain, shipping, warehousing, transportation"),
    ("real estate", "realestate, proptech, property"),
    ("telecom", "telecommunications, telco"),
    ("energy", "power, utilities, oil and gas, renewable, solar"),
    ("automotive", "auto, electric vehicle, ev"),
    ("media", "entertainment, streaming, ott, publishing"),
    ("gaming", "game, esports"),
    ("agriculture", "agri, farming, agritech"),
    ("government", "govtech, public sector"),
    ("hospitality", "hotel, tourism, restaurant"),
    ("construction", "infrastructure, civil engineering"),
    ("legal", "legaltech, law firm, law"),
    ("hr", "human resources, hrtech, talent, recruitment"),
    ("nonprofit", "ngo, social impact, charity"),
    ("saas", "software as a service, b2b saas, platform"),
    ("cloud", "cloud computing, devops"),
    ("cybersecurity", "infosec, security"),
    ("travel", "traveltech, booking, aviation"),
    ("food", "foodtech, food delivery"),
    ("sports", "sportstech, fitness"),
    ("blockchain", "web3, crypto, defi"),
    ("ai_ml", "artificial intelligence, machine learning, ai, data science, ml"),
    ("saas", "technology"),
)


def _flat(groups: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    return tuple((alias, industry) for industry, aliases in groups for alias in aliases.split(", "))


COST_ALIASES = _flat(_COST_ALIAS_GROUPS)

# --------------------------------------------------------------------------
# Aliases on the prompt side, in order.
# --------------------------------------------------------------------------
_PROMPT_ALIAS_GROUPS = (
    ("healthcare", "health, medical, hospital"),
    ("pharmaceuticals", "pharma, pharmaceutical, biotech"),
    ("finance", "banking, bank, financial, capital markets"),
    ("insurance", "insurance, insurtech"),
    ("fintech", "fintech, payments, lending"),
    ("ecommerce", "e-commerce, ecom, online store, marketplace"),
    ("retail", "retail, fmcg, consumer goods"),
    ("education", "education, edtech, university, school"),
    ("manufacturing", "manufacturing, factory, industrial"),
    ("logistics", "logistics, supply chain, shipping, warehousing, transportation"),
    ("real estate", "real estate, realestate, proptech, property"),
    ("telecom", "telecom, telecommunications, telco"),
    ("energy", "energy, power, utilities, oil and gas, renewable, solar"),
    ("automotive", "automotive, auto, electric vehicle, ev"),
    ("media", "media, entertainment, streaming, ott, publishing"),
    ("gaming", "gaming, game, esports"),
    ("agriculture", "agriculture, agri, farming, agritech"),
    ("government", "government, govtech, public sector, civic"),
    ("hospitality", "hospitality, hotel, tourism, restaurant"),
    ("construction", "construction"),
    ("cloud", "infrastructure"),
    ("construction", "civil engineering"),
    ("legal", "legal, legaltech, law firm, law"),
    ("hr", "hr, human resources, hrtech, talent, recruitment"),
    ("nonprofit", "nonprofit, ngo, social impact, charity"),
    ("saas", "saas, software as a service, b2b saas, platform"),
    ("cloud", "cloud, cloud computing, devops"),
    ("cybersecurity", "cybersecurity, infosec, security"),
    ("travel", "travel, traveltech, booking, aviation"),
    ("food", "food, foodtech, food delivery, restaurant tech"),
    ("sports", "sports, sportstech, fitness"),
    ("blockchain", "blockchain, web3, crypto, defi"),
    ("ai_ml", "ai_ml, artificial intelligence, machine learning, ai, data science, ml"),
    ("saas", "technology"),
)

KB_ALIASES = _flat(_PROMPT_ALIAS_GROUPS)

# --------------------------------------------------------------------------
# Industry-specific team roles, one person each.
# --------------------------------------------------------------------------
EXTRA_ROLES = (
    ("healthcare", "Health IT / Compliance Specialist", 1, "Part-time"),
    ("finance", "Security / Compliance Analyst", 1, "Part-time"),
    ("fintech", "Regulatory Compliance Engineer", 1, "Part-time"),
    ("insurance", "Business Analyst (Insurance Domain)", 1, "Part-time"),
    ("pharmaceuticals", "GxP Validation Specialist", 1, "Part-time"),
    ("manufacturing", "Industrial IoT Engineer", 1, "Part-time"),
    ("cybersecurity", "Security Engineer / Penetration Tester", 1, "Part-time"),
    ("government", "Accessibility / Compliance Specialist", 1, "Part-time"),
    ("ai_ml", "ML Engineer / Data Scientist", 1, "Full-time"),
    ("blockchain", "Smart Contract Developer / Auditor", 1, "Part-time"),
    ("gaming", "Game Server / Infrastructure Engineer", 1, "Full-time"),
    ("energy", "SCADA / OT Integration Specialist", 1, "Part-time"),
    ("telecom", "Network Integration Engineer", 1, "Part-time"),
)

# Stack items that call for a UI/UX designer.
FRONTEND_STACKS = (
    "react", "vue.js", "vue", "angular", "next.js", "svelte", "flutter",
    "react native", "swift", "kotlin", "ionic",
)

# --------------------------------------------------------------------------
# Knowledge base: six text fields per industry, composed from what the industry
# handles (thing), one piece of its work (unit), whom it serves and who leads it.
# --------------------------------------------------------------------------
KB_FIELDS = ("compliance", "kpis", "risks", "tech_trends", "terminology", "stakeholders")

# industry: thing | unit | people | lead
_KB_WORDS = """
healthcare: medicine | appointment | patients | hospital director
finance: money | transfer | account holders | bank director
fintech: digital money | app payment | app users | company founder
insurance: cover | claim | policy holders | claims director
pharmaceuticals: drugs | production batch | prescribers | laboratory director
ecommerce: goods | web order | shoppers | shop director
retail: shelves | sale | customers | store manager
education: teaching | lesson | students | headteacher
manufacturing: machines | production order | factory workers | works manager
logistics: freight | delivery | consignees | transport manager
real estate: buildings | tenancy | tenants | property manager
telecom: networks | call | subscribers | network manager
energy: electricity | meter reading | households | grid manager
automotive: vehicles | built vehicle | drivers | assembly manager
media: programmes | broadcast | viewers | programme director
gaming: games | match | players | game producer
agriculture: crops | harvest | growers | farm owner
government: public services | application form | citizens | agency head
hospitality: rooms | stay | guests | hotel owner
construction: building sites | building stage | site workers | construction manager
legal: cases | court date | clients | law partner
hr: staff | vacancy | applicants | personnel director
nonprofit: donations | donation | donors | board of trustees
saas: software | subscription | user accounts | product manager
cloud: servers | deployment | operators | infrastructure manager
cybersecurity: protection | security alert | protected users | security manager
travel: journeys | reservation | travellers | tour director
food: meals | kitchen order | diners | kitchen manager
sports: competitions | fixture | fans | club manager
blockchain: ledgers | ledger entry | key holders | protocol maintainer
ai_ml: models | prediction | model users | research lead
"""


def _kb_row(industry: str, thing: str, unit: str, people: str, lead: str) -> tuple[str, ...]:
    return (
        industry, f"laws on {thing}, privacy of {people}", f"{unit} volume, cost for each {unit}, complaints from {people}",
        f"{unit} backlog, failing systems for {thing}", f"automatic handling of each {unit}, self-service for {people}",
        f"{thing}, {unit}, {people}", f"{lead}, spokespeople of the {people}",
    )


def _kb_rows() -> tuple[tuple[str, ...], ...]:
    rows = []
    for line in _KB_WORDS.strip().splitlines():
        industry, words = line.split(": ", 1)
        rows.append(_kb_row(industry, *words.split(" | ")))
    return tuple(rows)


KNOWLEDGE_BASE = _kb_rows()

MULTIPLIER_COLUMNS = ("industry", "dev_pct", "infra_pct", "contingency_pct", "reason")
ALIAS_COLUMNS = ("ord", "alias", "industry")
ROLE_COLUMNS = ("industry", "role", "headcount", "allocation")
KB_COLUMNS = ("industry", *KB_FIELDS)


def values_sql(rows, columns) -> str:
    """``rows`` as an inline SQL table, readable by Spark and by any ANSI engine."""

    def literal(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def numbered(aliases) -> list[tuple[int, str, str]]:
    return [(i, alias, industry) for i, (alias, industry) in enumerate(aliases)]


def industry_multipliers(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(MULTIPLIERS, MULTIPLIER_COLUMNS))


def industry_aliases(spark: SparkSession, aliases=COST_ALIASES) -> DataFrame:
    return spark.sql(values_sql(numbered(aliases), ALIAS_COLUMNS))


def industry_extra_roles(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(EXTRA_ROLES, ROLE_COLUMNS))


def industry_knowledge(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(KNOWLEDGE_BASE, KB_COLUMNS))


def lookup(requests: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join one of the seed tables above on ``key``; its size is fixed, so broadcast it."""
    dim = dim.withColumnRenamed("industry", "_dim_industry")
    return requests.join(
        F.broadcast(dim), requests[key] == dim["_dim_industry"], how
    ).drop("_dim_industry")
