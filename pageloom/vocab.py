"""Default word lists and rules.

Every operator takes its list as a parameter; these are the defaults.  They are
small and fixed, so they travel inside the plan as literals, never as a join.
"""

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Results depend on these lists being exactly so.
# ---------------------------------------------------------------------------

STOP_WORDS = """
a about above after again against all am an and any are as at be because been
before being below between both but by can cannot could did do does doing don't
down during each few for from further get got had has have having he her here
hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not of off on once only or other our ours ourselves out over
own same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was we were what
when where which while who whom why will with would you your yours yourself
yourselves
""".split()

TOPIC_TERMS = """
election government parliament policy president minister vote democrat
republican legislat law court bill
economy market gdp inflation stock trade bank invest merger acquisit revenue
profit startup
technolog software artifici intellig cybersecur digital platform app cloud chip
robot data
health vaccine virus cancer research scientist climate environment energy
nuclear space discoveri
report survey announc conflict war crisis disaster accid murder arrest trial
sentenc
""".split()

ARTICLE_SIGNALS = """
article news story post blog report feature opinion editorial breaking world
local politics technology science health sports business finance
""".split()

# "contract" and "sitemap," (with the comma) are part of the expected list.
NOISE_SIGNALS = """
login signup register subscribe advertise contract about privacy terms cookie
search tag category author page feed rss sitemap,
""".split()

# Tried in this order; the first label with a matching signal wins.
CATEGORY_RULES = [
    ("Politics", "elect parliament vote democrat republican legislat polic".split()),
    ("Business", "market gdp inflat stock trade invest bank revenue startup".split()),
    ("Health & Science", "technolog softwar virus cancer hospital diseas medic".split()),
    ("Environment", "health environment energi emiss renewabl".split()),
    ("Sports", "match goal tournament footbal sport athlete".split()),
]
DEFAULT_CATEGORY = "General News"

ENTITY_LABELS = [
    "person", "organization", "location", "date", "event", "product",
    "law or regulation", "monetary value",
]

NO_TITLE = "(no title found)"
NO_BODY = "(body not extractable)"

DEFAULT_THRESHOLD = 0.05
KEYWORDS_PER_PAGE = 12
LINKS_PER_PAGE = 30
ENTITIES_PER_PAGE = 15
PAGES_PER_SEED = 5


def vocabulary(spark: SparkSession) -> DataFrame:
    """All default lists as one table ``(list, ordinal, label, word)``."""
    rows = [
        (name, i, None, word)
        for name, words in [
            ("stop_word", STOP_WORDS),
            ("topic_term", TOPIC_TERMS),
            ("article_signal", ARTICLE_SIGNALS),
            ("noise_signal", NOISE_SIGNALS),
            ("entity_label", ENTITY_LABELS),
        ]
        for i, word in enumerate(words)
    ]
    rows += [
        ("category_rule", i, label, word)
        for i, (label, words) in enumerate(CATEGORY_RULES)
        for word in words
    ]
    return spark.createDataFrame(rows, "list string, ordinal int, label string, word string")
