"""T01-T07 over whole documents, with keyword lists that occur in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import text as X
from wardlight.plans.registry import query
from wardlight.plans.sql import with_views

# Labels, words and categories for the given documents.
KEYWORDS = {
    "Alpha": ["the", "tion"],
    "Beta": ["que", "ment"],
    "Gamma": ["der", "ein", "sch"],
    "Delta": ["###", "!"],
}
RULES = {"Alpha": "ECONOMY", "Beta": "LARGE", "Gamma": "MEDIUM"}
URGENCY = {"critical": ["###"], "high": ["erin", "schich"], "medium": ["tion", "que", "der"]}
EMOTION = {"anger": ["!", "@"], "concern": ["the"], "frustration": ["que", "der"]}
LEXICON = [("the", 0.5), ("of", -1.2), ("la", 1.1), ("que", -0.7), ("die", 0.9), ("der", -1.5), ("el", 0.4), ("in", -0.3)]


def _hits(words):
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words) + ")"


SCORES = (
    "h AS (SELECT doc_id, text, "
    + ", ".join(f"{_hits(w)} AS h{n}" for n, w in enumerate(KEYWORDS.values()))
    + " FROM documents), scores AS (SELECT doc_id, text, label, hits, pos, greatest(0.1, hits)::DOUBLE / total AS score, "
    + "row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, text, '{label}' AS label, h{n} AS hits, {n} AS pos, "
        + " + ".join(f"greatest(0.1, h{m})::DOUBLE" for m in range(len(KEYWORDS)))
        + " AS total FROM h"
        for n, label in enumerate(KEYWORDS)
    )
    + "))"
)


@query(
    "t01_category_scores",
    f"WITH {SCORES} SELECT doc_id, label, hits, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM scores",
)
def t01(r):
    out = X.category_scores(r.docs, KEYWORDS)
    return out.withColumn("score", F.round("score", 6))


@query(
    "t01_keyword_table",
    f"WITH {SCORES} SELECT doc_id, label, hits, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM scores",
)
def t01_table(r):
    """The same scores with the keywords in a table."""
    listed = [(label, n, w) for n, (label, words) in enumerate(KEYWORDS.items()) for w in words]
    out = X.keyword_scores(r.docs, r.values(listed, "label, label_no, keyword"))
    return out.withColumn("score", F.round("score", 6))


@query(
    "t02_suggest_categories",
    with_views(
        "cat",
        f"""WITH {SCORES}, m AS (SELECT s.doc_id, s.rank, s.score, c.cat_id, c.cat_name, c.icon_class FROM scores s JOIN cat c ON c.is_active AND c.cat_name =
          CASE label WHEN 'Alpha' THEN 'ECONOMY' WHEN 'Beta' THEN 'LARGE' WHEN 'Gamma' THEN 'MEDIUM' ELSE 'Other' END
          WHERE length(trim(text, ' ')) >= 5)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS INTEGER) AS rank, cat_id, cat_name, icon_class AS icon,
          round(score, 4) AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) <= 3""",
    ),
)
def t02(r):
    return X.suggest_categories(r.docs, r.cat, KEYWORDS, RULES)


_WORDS = [w for ws in URGENCY.values() for w in ws]
_N = _hits(_WORDS)
_ANGER = f"least(10.0, greatest(0.0, least(2.0, (length(text) - length(replace(text, '!', ''))) * 0.25) + CASE WHEN {_N} > 0 THEN 1.5 ELSE 0.0 END))"


def _any(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


T03 = f"""SELECT doc_id, CAST({_ANGER} AS DOUBLE) AS anger, {_N} AS n, CASE WHEN {_any(URGENCY['critical'])} OR {_ANGER} >= 8 THEN 'critical'
        WHEN {_any(URGENCY['high'])} OR {_ANGER} >= 6 THEN 'high' WHEN {_ANGER} >= 3 THEN 'medium' ELSE 'low' END AS urgency_level,
        array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _WORDS)}],
          lambda x: x IS NOT NULL)), ',') AS keywords FROM documents"""


@query(
    "t03_score_urgency",
    f"""SELECT doc_id, round(anger, 2) AS anger_level, CAST(round(least(1.0, n * 0.1), 3) AS DOUBLE) AS emotional_intensity, urgency_level, keywords,
      CASE urgency_level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS priority_recommendation,
      CAST(round(least(0.99, 0.55 + least(1.0, n * 0.1) * 0.35), 2) AS DOUBLE) AS confidence FROM ({T03})""",
)
def t03(r):
    out = X.score_urgency(r.docs, URGENCY)
    return out.select(
        "doc_id",
        "anger_level",
        "emotional_intensity",
        "urgency_level",
        F.array_join("keywords_found", ",").alias("keywords"),
        "priority_recommendation",
        "confidence",
    )


_LEX = ", ".join(f"('{t}', CAST({v} AS DECIMAL(10,4)))" for t, v in LEXICON)


@query(
    "t04_polarity",
    f"""WITH lex AS (SELECT * FROM (VALUES {_LEX}) v(token, value)),
      tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}'']+')) AS token FROM documents),
      s AS (SELECT doc_id, sum(value) AS x FROM tok JOIN lex USING (token) GROUP BY 1)
      SELECT d.doc_id, round(coalesce(x, 0)::DOUBLE / sqrt(coalesce(x, 0)::DOUBLE ** 2 + 15), 4) AS compound FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
)
def t04(r):
    lexicon = r.values(LEXICON, "token, value").withColumn("value", F.col("value").cast("double"))
    return X.polarity(r.docs.select("doc_id", "text"), lexicon).select("doc_id", "compound")


@query(
    "t05_score_urgency_v2",
    f"""SELECT doc_id, CAST(0 AS DOUBLE) AS sentiment_score, urgency_level, round(least(1.0, e / 3.0), 4) AS emotional_intensity,
      CASE urgency_level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS priority_recommendation
      FROM (SELECT doc_id, CASE WHEN {_any(["###"])} THEN 'critical' WHEN {_any(_WORDS)} THEN 'high' ELSE 'low' END AS urgency_level,
        {_hits([w for g in EMOTION.values() for w in g])} AS e FROM documents)""",
)
def t05(r):
    out = X.score_urgency_v2(r.docs, URGENCY, EMOTION, ["###"])
    return out.select("doc_id", "sentiment_score", "urgency_level", "emotional_intensity", "priority_recommendation")


@query(
    "t06_issue_from_hint",
    """SELECT page_id, CASE WHEN contains(u, 'pothole') OR contains(u, 'road') THEN 'Pothole / Road Damage'
      WHEN contains(u, 'garbage') THEN 'Garbage Not Collected' WHEN contains(u, 'water supply') THEN 'Water Supply Issue'
      WHEN contains(u, 'sewage') THEN 'Sewage Overflow' WHEN contains(u, 'light') THEN 'Street Light Not Working'
      WHEN contains(u, 'electricity') OR contains(u, 'power') THEN 'Electricity Outage' WHEN contains(u, 'traffic') THEN 'Traffic Signal Issue'
      WHEN contains(u, 'stray') OR contains(u, 'animal') THEN 'Stray Animal Menace' WHEN contains(u, 'park') THEN 'Park / Green Area Damage'
      WHEN contains(u, 'dump') THEN 'Illegal Dumping' ELSE 'Other' END AS issue, 0.87::DOUBLE AS confidence
      FROM (SELECT page_id, lower(html) AS u FROM pages)""",
)
def t06(r):
    out = X.issue_from_hint(r.t["pages"], "html", "issue")
    return out.select("page_id", "issue", "confidence")


@query("t07_score_distinct", f"SELECT doc_id, round(anger, 2) AS anger_level, urgency_level FROM ({T03})")
def t07(r):
    def scorer(docs):
        return X.score_urgency(docs, URGENCY).select("_hash", "text", "anger_level", "urgency_level")

    return X.score_distinct(r.docs.select("doc_id", "text"), scorer)
