"""SQL pieces of the expected results, written from the rules, not from the library."""

from __future__ import annotations

from checks.inputs import LISTING_SQL
from hemline import constants as C
from hemline import valence as V


def text_list(words) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


def rows(pairs) -> str:
    return ", ".join(
        "(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in pair) + ")"
        for pair in pairs
    )


def hits(text: str, words) -> str:
    """How many of ``words`` occur in ``text``."""
    return " + ".join(f"CAST(contains({text}, '{word}') AS INT)" for word in words)


def any_hit(text: str, words) -> str:
    return "coalesce(" + " OR ".join(f"contains({text}, '{word}')" for word in words) + ", FALSE)"


def durability(text: str) -> str:
    low = f"lower({text})"
    return f"coalesce(({hits(low, C.DURABLE_PHRASES)}) - ({hits(low, C.FRAGILE_PHRASES)}), 0)"


def claim(text: str) -> str:
    return any_hit(f"lower({text})", C.CLAIM_KEYWORDS)


def category(brand: str) -> str:
    return (
        f"CASE WHEN lower({brand}) IN ({text_list(C.FAST_FASHION_BRANDS)}) THEN 'fast_fashion' "
        f"WHEN lower({brand}) IN ({text_list(C.SUSTAINABLE_BRANDS)}) THEN 'sustainable' END"
    )


def price_strip(text: str) -> str:
    return f"TRY_CAST(regexp_replace({text}, '[^0-9.]', '', 'g') AS DOUBLE)"


def first_number(text: str) -> str:
    return f"TRY_CAST(regexp_extract({text}, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE)"


def clean(text: str) -> str:
    """Forum cleaning as nested replacements."""
    steps = [
        r"\[[^\]]+\]\([^\)]+\)", r"https?://\S+|www\.\S+", r"/u/\S+|u/\S+|@\S+", r"<[^>]+>",
        r"[^a-z0-9\s]", r"\s+",
    ]
    sql = f"lower({text})"
    for step in steps:
        sql = f"regexp_replace({sql}, '{step}', ' ', 'g')"
    return f"trim({sql})"


# parts(doc_id, pos, material, share): one row per part of a composition that names something.
PARTS = f"""
listing AS ({LISTING_SQL}),
pieces AS (
  SELECT doc_id, pos, trim(piece) AS piece FROM (
    SELECT doc_id, unnest(string_split_regex(lower(materials), '[,/;+]')) AS piece,
           generate_subscripts(string_split_regex(lower(materials), '[,/;+]'), 1) AS pos
    FROM listing WHERE materials IS NOT NULL)
  WHERE trim(piece) <> ''),
read_pieces AS (
  SELECT doc_id, pos, regexp_matches(piece, '[0-9]{{1,3}}\\s*%\\s*[a-z\\s]+') AS stated,
         trim(regexp_extract(piece, '([0-9]{{1,3}})\\s*%\\s*([a-z\\s]+)', 2)) AS after_percent,
         TRY_CAST(regexp_extract(piece, '([0-9]{{1,3}})\\s*%\\s*([a-z\\s]+)', 1) AS DOUBLE) / 100 AS percent,
         trim(regexp_replace(piece, '[^a-z\\s]', '', 'g')) AS letters
  FROM pieces),
named AS (
  SELECT doc_id, pos, CASE WHEN stated THEN after_percent ELSE letters END AS material,
         CASE WHEN stated THEN least(percent, 1.0) ELSE 0.0 END AS share
  FROM read_pieces WHERE stated OR letters <> ''),
parts AS (
  SELECT doc_id, pos, material,
         CASE WHEN sum(share) OVER (PARTITION BY doc_id) > 0
              THEN share / sum(share) OVER (PARTITION BY doc_id)
              ELSE 1.0 / count(*) OVER (PARTITION BY doc_id) END AS frac
  FROM named),
canonical AS (
  SELECT *, CASE WHEN contains(m, 'organic cotton') THEN 'organic cotton' WHEN contains(m, 'cotton') THEN 'cotton'
                 WHEN contains(m, 'virgin polyester') THEN 'virgin polyester'
                 WHEN contains(m, 'recycled polyester') THEN 'recycled polyester' ELSE m END AS base
  FROM (SELECT *, replace(material, 'elastane', 'spandex') AS m FROM parts)),
scores(rank, term, score) AS (VALUES {", ".join(f"({i}, '{k}', CAST({v} AS DOUBLE))" for i, (k, v) in enumerate(C.MATERIAL_SCORES))}),
scored_parts AS (
  SELECT c.doc_id, c.pos, c.material, c.base, c.frac, coalesce(arg_min(s.score, s.rank), 5.0) AS score
  FROM canonical c LEFT JOIN scores s ON contains(c.base, s.term) GROUP BY ALL),
quality AS (SELECT doc_id, CAST(sum(frac * score) AS DOUBLE) AS quality FROM scored_parts GROUP BY doc_id)
"""


def half_even(value: str, digits: int) -> str:
    """Round as the scores are defined: a tie goes to the even neighbour."""
    scaled = f"({value}) * {10 ** digits}"
    return (f"CASE WHEN abs({scaled} - trunc({scaled})) = 0.5 AND trunc({scaled}) % 2 = 0 "
            f"THEN trunc({scaled}) / {10 ** digits} ELSE round({value}, {digits}) END")


def sentiment(texts: str, lexicon: str) -> str:
    """CTEs ending in ``sentiment(key, neg, neu, pos, compound)``.

    ``texts`` yields (key, body) and ``lexicon`` (term, valence).
    """
    edge = r"""(?:[.!?,;:\-''"]|!!!?|\?\?\??|\?!\?!?|!\?!\??)"""
    body = r"([^\s!-/:-@\[-`{-~]{2,})"
    boosters = text_list(V.INTENSIFIERS + V.DAMPENERS)

    def step(value: str, back: int, weight: float) -> str:
        """The value after the word ``back`` places before has been looked at."""
        never = {
            1: "NULL",
            2: "CASE WHEN w2 = 'never' AND w1 IN ('so', 'this') THEN 1.5 END",
            3: "CASE WHEN (w3 = 'never' AND w2 IN ('so', 'this')) OR w1 IN ('so', 'this') THEN 1.25 END",
        }[back]
        return f"""CASE WHEN pos_at > {back - 1} AND l{back} IS NULL THEN
          ({value} + CASE WHEN low{back} IN ({boosters}) THEN {weight} * (
              (CASE WHEN low{back} IN ({text_list(V.INTENSIFIERS)}) THEN 0.293 ELSE -0.293 END)
                * (CASE WHEN {value} < 0 THEN -1 ELSE 1 END)
              + CASE WHEN mixed AND up{back} THEN (CASE WHEN {value} > 0 THEN 0.733 ELSE -0.733 END) ELSE 0 END)
            ELSE 0 END)
          * coalesce({never}, CASE WHEN low{back} IN ({text_list(V.NEGATIONS)}) OR contains(low{back}, 'n''t')
                              THEN -0.74 ELSE 1 END)
          ELSE {value} END"""

    return f"""
texts AS ({texts}),
lexicon AS ({lexicon}),
raw_words AS (
  SELECT key, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos_at FROM (
    SELECT key, list_filter(string_split_regex(body, '\\s+'), lambda w: length(w) > 1) AS l FROM texts)),
bare_words AS (
  SELECT key, pos_at, CASE
      WHEN regexp_matches(w, '^{edge}{body}$') THEN regexp_replace(w, '^{edge}{body}$', '\\1')
      ELSE regexp_replace(w, '^{body}{edge}$', '\\1') END AS w
  FROM raw_words),
words AS (
  SELECT b.key, b.pos_at, b.w, lower(b.w) AS low, (b.w = upper(b.w) AND b.w <> lower(b.w)) AS up, x.valence AS l
  FROM bare_words b LEFT JOIN lexicon x ON lower(b.w) = x.term),
around AS (
  SELECT *, {", ".join(
      f"lag({c}, {k}) OVER place AS {c}{k}" for k in (1, 2, 3) for c in ("w", "low", "up", "l"))},
      lead(w, 1) OVER place AS next1, lead(w, 2) OVER place AS next2
  FROM words WINDOW place AS (PARTITION BY key ORDER BY pos_at)),
per_text AS (
  SELECT key, count(*) AS n, bool_or(up) AND bool_or(NOT up) AS mixed,
         min(CASE WHEN low = 'but' THEN pos_at END) AS but_at
  FROM words GROUP BY key),
first_place AS (
  SELECT a.*, p.mixed FROM around a JOIN per_text p USING (key)
  WHERE a.l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.key, a.w ORDER BY a.pos_at) = 1),
step0 AS (
  SELECT *, CAST(l AS DOUBLE) + CASE WHEN mixed AND up THEN (CASE WHEN l > 0 THEN 0.733 ELSE -0.733 END) ELSE 0 END AS v0
  FROM first_place),
step1 AS (SELECT *, {step("v0", 1, 1.0)} AS v1 FROM step0),
step2 AS (SELECT *, {step("v1", 2, 0.95)} AS v2 FROM step1),
step3 AS (SELECT *, {step("v2", 3, 0.9)} AS v3 FROM step2),
idioms(phrase, own) AS (VALUES {rows(V.IDIOMS)}),
step4 AS (
  SELECT s.*, CASE WHEN pos_at > 2 AND l3 IS NULL THEN
      coalesce(
        (SELECT own FROM idioms WHERE phrase = w || ' ' || next1 || ' ' || next2),
        (SELECT own FROM idioms WHERE phrase = w || ' ' || next1),
        (SELECT own FROM idioms WHERE phrase = w1 || ' ' || w),
        (SELECT own FROM idioms WHERE phrase = w2 || ' ' || w1 || ' ' || w),
        (SELECT own FROM idioms WHERE phrase = w2 || ' ' || w1),
        (SELECT own FROM idioms WHERE phrase = w3 || ' ' || w2 || ' ' || w1),
        (SELECT own FROM idioms WHERE phrase = w3 || ' ' || w2),
        v3)
      + CASE WHEN (w3 || ' ' || w2) IN ({text_list(V.DAMPENER_PAIRS)}) OR (w2 || ' ' || w1) IN ({text_list(V.DAMPENER_PAIRS)})
             THEN -0.293 ELSE 0 END
    ELSE v3 END AS v4
  FROM step3 s),
step5 AS (
  SELECT key, w, CASE WHEN low = 'kind' AND lower(next1) = 'of' THEN 0 ELSE 1 END * v4 * CASE WHEN pos_at > 0 AND l1 IS NULL AND low1 = 'least'
                           AND NOT (pos_at > 1 AND low2 IN ('at', 'very')) THEN -0.74 ELSE 1 END AS value
  FROM step4),
valued AS (
  SELECT a.key, s.value * CASE WHEN p.but_at IS NULL OR a.pos_at = p.but_at THEN 1.0 WHEN a.pos_at < p.but_at THEN 0.5 ELSE 1.5 END AS value
  FROM around a JOIN step5 s ON a.key = s.key AND a.w = s.w JOIN per_text p ON a.key = p.key
  WHERE a.l IS NOT NULL AND a.low NOT IN ({boosters})),
sums AS (
  SELECT key, sum(value) AS total, sum(CASE WHEN value > 0 THEN value + 1 ELSE 0 END) AS pos,
         -sum(CASE WHEN value < 0 THEN value - 1 ELSE 0 END) AS neg, count(*) FILTER (WHERE value <> 0) AS hits
  FROM valued GROUP BY key),
marks AS (
  SELECT t.key, p.n, coalesce(s.total, 0) AS total, coalesce(s.pos, 0) AS pos, coalesce(s.neg, 0) AS neg,
         coalesce(s.hits, 0) AS hits,
         least(length(body) - length(replace(body, '!', '')), 4) * 0.292
         + CASE WHEN length(body) - length(replace(body, '?', '')) > 3 THEN 0.96
                WHEN length(body) - length(replace(body, '?', '')) > 1 THEN (length(body) - length(replace(body, '?', ''))) * 0.18
                ELSE 0 END AS emphasis
  FROM texts t LEFT JOIN per_text p USING (key) LEFT JOIN sums s USING (key)),
masses AS (
  SELECT key, n, total + sign(total) * emphasis AS total, n - hits AS neu,
         pos + CASE WHEN pos > neg THEN emphasis ELSE 0 END AS pos,
         neg + CASE WHEN pos < neg THEN emphasis ELSE 0 END AS neg
  FROM marks),
sentiment AS (
  SELECT key,
         coalesce({half_even("CAST(neg AS DOUBLE) / (neg + neu + pos)", 3)}, 0.0) AS neg,
         coalesce({half_even("CAST(neu AS DOUBLE) / (neg + neu + pos)", 3)}, 0.0) AS neu,
         coalesce({half_even("CAST(pos AS DOUBLE) / (neg + neu + pos)", 3)}, 0.0) AS pos,
         CASE WHEN n IS NULL THEN 0.0 ELSE {half_even("CAST(total / sqrt(total * total + 15) AS DOUBLE)", 4)} END AS compound
  FROM masses)
"""


DEFAULT_LEXICON = f"SELECT * FROM (VALUES {rows(V.DEFAULT_LEXICON.items())}) AS x(term, valence)"

# enriched(doc_id, price, durability_score, quality, compound, brand_category, has_claim, cpw)
ENRICHED = (
    PARTS + ", " + sentiment(
        "SELECT doc_id AS key, coalesce(review_text, '') || ' ' || coalesce(description, '') AS body FROM listing",
        DEFAULT_LEXICON,
    ) + f""",
products AS (
  SELECT l.doc_id, {price_strip("l.price_text")} AS price, {durability("t.body")} AS durability_score,
         q.quality, s.compound, {category("l.brand")} AS brand_category, {claim("l.description")} AS has_claim
  FROM listing l JOIN texts t ON l.doc_id = t.key JOIN sentiment s ON l.doc_id = s.key
  LEFT JOIN quality q ON l.doc_id = q.doc_id),
enriched AS (
  SELECT *, CASE WHEN durability_score > 0 THEN price / durability_score END AS cpw FROM products)
"""
)
