"""The registered queries in plain SQL over the star-schema tables (DuckDB dialect)."""

from __future__ import annotations

from punctual.catalogue.queries import CITY_MIN_ORDERS, POINT_STEPS
from punctual.catalogue.stand_ins import LEXICON
from punctual.functions.theme_json import SEVERITIES, THEMES
from punctual.operators import bootstrap, outliers
from punctual.operators.robust_points import NEAREST

_CTES = {
    "b_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp,
               (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)
                   AS order_delivered_customer_date,
               o_orderdate + INTERVAL 1800 DAY AS order_estimated_delivery_date
        FROM orders""",
    "b_order_reviews": """
        SELECT CASE WHEN event_id % 100 = 99 THEN event_id - 1 ELSE event_id END AS review_id,
               event_id AS order_id,
               CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3
                    WHEN 'click' THEN 4 ELSE 5 END AS review_score,
               source AS review_comment_title,
               text AS review_comment_message,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS review_answer_timestamp
        FROM events LEFT JOIN documents ON doc_id = event_id""",
    "b_order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_suppkey AS seller_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
               CAST(l_quantity AS DECIMAL(18,2)) AS freight_value
        FROM lineitem""",
    "b_order_payments": """
        SELECT l_orderkey AS order_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_value,
               l_linenumber AS payment_installments
        FROM lineitem""",
    "b_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_unique_id, r_name AS customer_state,
               c_nationkey AS customer_zip_code_prefix,
               n_name || '-' || c_mktsegment AS customer_city
        FROM customer JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
    "b_geolocation": """
        SELECT s_nationkey AS geolocation_zip_code_prefix, s_acctbal / 1000 AS geolocation_lat,
               CAST(s_suppkey AS DOUBLE) / 10 AS geolocation_lng, n_name AS geolocation_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "s_orders": "SELECT * FROM b_orders WHERE order_delivered_customer_date IS NOT NULL",
    "s_reviews": """
        SELECT DISTINCT ON (review_id) *
        FROM b_order_reviews
        WHERE order_id IN (SELECT order_id FROM s_orders)
        ORDER BY review_id, review_comment_message IS NULL, review_answer_timestamp DESC NULLS LAST,
                 order_id NULLS LAST""",
    "s_items": """
        SELECT order_id, count(*) AS n_items, count(DISTINCT seller_id) AS n_sellers,
               CAST(sum(price) AS DOUBLE) AS items_total,
               CAST(sum(freight_value) AS DOUBLE) AS freight_total
        FROM b_order_items GROUP BY order_id""",
    "s_payments": """
        SELECT order_id, CAST(sum(payment_value) AS DOUBLE) AS payment_total,
               count(*) AS n_payments, max(payment_installments) AS max_installments
        FROM b_order_payments GROUP BY order_id""",
    "s_points": """
        SELECT geolocation_zip_code_prefix AS zip_prefix, {mean geolocation_lat} AS lat,
               {mean geolocation_lng} AS lng, max(geolocation_state) AS geo_state
        FROM b_geolocation GROUP BY 1""",
    "gold": """
        SELECT review_id, order_id, review_score, review_comment_title, review_comment_message,
               review_comment_message IS NOT NULL AS has_text, order_purchase_timestamp,
               order_delivered_customer_date, order_estimated_delivery_date, customer_unique_id,
               customer_state, customer_zip_code_prefix, customer_city, round(lat, 6) AS customer_lat,
               round(lng, 6) AS customer_lng, lat, lng, n_items, n_sellers, items_total,
               freight_total, payment_total, max_installments
        FROM s_orders JOIN s_reviews USING (order_id) JOIN b_customers USING (customer_id)
             LEFT JOIN s_items USING (order_id) LEFT JOIN s_payments USING (order_id)
             LEFT JOIN s_points ON zip_prefix = customer_zip_code_prefix""",
    "features": """
        SELECT *, date_diff('microsecond', order_delivered_customer_date,
                            order_estimated_delivery_date) / 1e6 / 86400.0::DOUBLE
                      AS delivery_gap_days,
               order_delivered_customer_date > order_estimated_delivery_date AS is_late,
               CASE WHEN order_delivered_customer_date > order_estimated_delivery_date
                    THEN 'Late' ELSE 'On-time' END AS delivery_outcome,
               review_score <= 2 AS is_negative
        FROM gold""",
    # Sentiment with the stand-in model and lexicon.
    "lexicon": "SELECT * FROM (VALUES {lexicon}) v(token, valence)",
    "tokens": r"""
        SELECT review_id,
               unnest(regexp_split_to_array(lower(review_comment_message),
                                            '[^\p{L}\p{M}\p{N}]+')) AS token
        FROM features WHERE has_text""",
    "valences": """
        SELECT review_id, CAST(sum(CAST(valence AS DECIMAL(9,4))) AS DOUBLE) AS total
        FROM tokens JOIN lexicon USING (token) GROUP BY review_id""",
    "scored": """
        SELECT review_id, 1 + length(review_comment_message) % 5 AS star_a,
               round(coalesce(total, 0) / sqrt(coalesce(total, 0) * coalesce(total, 0) + 15), 4)
                   AS compound_b,
               review_score, review_comment_message
        FROM features LEFT JOIN valences USING (review_id) WHERE has_text""",
    "labelled": """
        SELECT review_id, CAST(star_a AS INTEGER) AS star_a, compound_b, review_score,
               CASE WHEN star_a < 3 THEN 'negative' WHEN star_a = 3 THEN 'neutral'
                    ELSE 'positive' END AS label_a,
               CASE WHEN compound_b >= 0.05 THEN 'positive' WHEN compound_b <= -0.05 THEN 'negative'
                    ELSE 'neutral' END AS label_b,
               CASE WHEN review_score < 3 THEN 'negative' WHEN review_score = 3 THEN 'neutral'
                    ELSE 'positive' END AS label_truth,
               review_comment_message
        FROM scored""",
    "sentiment": """
        SELECT *, label_a = label_b AS ab_agree, label_a = label_truth AS a_valid,
               label_b = label_truth AS b_valid
        FROM labelled""",
    # Sampling and batching.
    "ranked": """
        SELECT review_id, review_comment_message,
               row_number() OVER (ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rank
        FROM features WHERE is_negative AND has_text""",
    "sample": "SELECT * FROM ranked WHERE rank <= 400",
    "half_sample": "SELECT * FROM ranked WHERE rank <= 150",
    # Rule labels over all raw negative reviews with text.
    "raw_negatives": """
        SELECT DISTINCT review_id FROM b_order_reviews
        WHERE review_score <= 2 AND review_comment_message IS NOT NULL""",
    "run_a": """
        SELECT review_id, {themes}[review_id % 8 + 1] AS theme FROM raw_negatives""",
    "run_b": """
        SELECT review_id, {themes}[(CASE WHEN review_id % 10 = 3 THEN review_id + 1
                                         ELSE review_id END) % 8 + 1] AS theme FROM raw_negatives""",
    "joined": """
        SELECT run_a.review_id, theme, delivery_outcome, review_comment_message
        FROM run_a LEFT JOIN features USING (review_id)""",
}


def _array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _mean(column: str) -> str:
    """Mean over exact decimals: summing doubles gives other last bits for every row order."""
    return f"CAST(sum(CAST({column} AS DECIMAL(25,15))) AS DOUBLE) / count({column})"


def _ctes() -> dict[str, str]:
    entries = ", ".join(f"('{token}', {valence})" for token, valence in LEXICON)
    fixed = {
        "{lexicon}": entries,
        "{themes}": _array(THEMES),
        "{mean geolocation_lat}": _mean("geolocation_lat"),
        "{mean geolocation_lng}": _mean("geolocation_lng"),
    }
    texts = {}
    for name, text in _CTES.items():
        for mark, value in fixed.items():
            text = text.replace(mark, value)
        texts[name] = text
    return texts


def _with(final: str) -> str:
    """``final`` behind the common table expressions."""
    parts = ",\n".join(f"{name} AS ({text})" for name, text in _ctes().items())
    return f"WITH {parts}\n{final}"


def _counts(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS n_rows FROM {name}"
        for label, name in tables.items()
    )


_GOLD_COLUMNS = """review_id, order_id, review_score, review_comment_title,
    review_comment_message, has_text, order_purchase_timestamp, order_delivered_customer_date,
    order_estimated_delivery_date, customer_unique_id, customer_state, customer_zip_code_prefix,
    customer_city, customer_lat, customer_lng, n_items, n_sellers, items_total, freight_total,
    payment_total, max_installments"""

_FEATURE_COLUMNS = f"""{_GOLD_COLUMNS},
    delivery_gap_days, is_late, delivery_outcome, is_negative"""

_SENTIMENT_COLUMNS = """review_id, star_a, compound_b, review_score, label_a, label_b, label_truth,
    ab_agree, a_valid, b_valid"""

_SCORE_BY_OUTCOME = """
    SELECT delivery_outcome, count(*) AS n_reviews, round_even(avg(review_score), 2) AS mean_score
    FROM features GROUP BY delivery_outcome"""

_DAILY = """,
    bins AS (SELECT unnest(range(-30, 60)) AS day),
    outcomes AS (SELECT unnest(['On-time', 'Late']) AS delivery_outcome)
    SELECT day + 31 AS bin, day::DOUBLE AS bin_start, (day + 1)::DOUBLE AS bin_end,
           o.delivery_outcome, count(delivery_gap_days) AS n
    FROM bins CROSS JOIN outcomes o
    LEFT JOIN features f
      ON f.delivery_outcome = o.delivery_outcome
     AND (f.delivery_gap_days >= day OR day = -30)
     AND (f.delivery_gap_days < day + 1 OR day = 59)
    GROUP BY ALL"""

_EQUAL_WIDTH = """,
    clipped AS (SELECT least(greatest(delivery_gap_days, -30.0::DOUBLE), 60.0::DOUBLE) AS gap,
                       delivery_outcome FROM features),
    bounds AS (SELECT min(gap) AS low, max(gap) AS high, count(gap) AS total FROM clipped),
    bins AS (
        SELECT i + 1 AS bin, low + i * ((high - low) / 60) AS bin_start,
               CASE WHEN i = 59 THEN high ELSE low + (i + 1) * ((high - low) / 60) END AS bin_end,
               total
        FROM bounds, (SELECT unnest(range(60)) AS i)),
    outcomes AS (SELECT unnest(['On-time', 'Late']) AS delivery_outcome)
    SELECT bin, bin_start, bin_end, o.delivery_outcome, count(gap) AS n, count(gap) / max(total) AS share
    FROM bins CROSS JOIN outcomes o
    LEFT JOIN clipped c
      ON c.delivery_outcome = o.delivery_outcome
     AND gap >= bin_start AND (gap < bin_end OR (bin = 60 AND gap = bin_end))
    GROUP BY ALL"""

_BLOCKS = """
    SELECT (rank - 1) // 25 AS batch_id, count(*) AS n_reviews,
           string_agg('- review_id=' || review_id || ': ' || {text}, chr(10) ORDER BY rank) AS reviews
    FROM {source} GROUP BY 1"""

_SUMMARY = """
    SELECT count(*) AS n, round_even(avg(a_valid::INT) * 100, 1) AS a_valid_pct,
           round_even(avg(b_valid::INT) * 100, 1) AS b_valid_pct,
           round_even(avg(ab_agree::INT) * 100, 1) AS ab_agree_pct,
           count(*) FILTER (NOT ab_agree) AS disagree_n
    FROM sentiment"""

_STABILITY = """
    SELECT count(*) AS n_both, avg((run_a.theme = run_b.theme)::INT) AS stability
    FROM run_a JOIN run_b USING (review_id)"""

_FREQUENCY_JSON = """
    '{{' || string_agg('"' || theme || '": ' || n, ', ' ORDER BY n DESC, theme) || '}}'
    FROM (SELECT theme, count(*) AS n FROM {labels} GROUP BY theme)"""


def _replicates(source: str, sums: str) -> str:
    """Weighted sums of the rows of ``source`` (with ``review_id``) in every bootstrap replicate."""
    weight = " + ".join(f"(h >= {b})::INT" for b in bootstrap.BOUNDS)
    return f"""
    drawn AS (SELECT *, unnest(range({bootstrap.REPLICATES})) AS replicate FROM {source}),
    hashed AS (SELECT *, ('0x' || substr(md5(review_id || ':' || (replicate // 4) || ':42'), 1 + 8 * (replicate % 4), 8))::BIGINT AS h FROM drawn),
    weighed AS (SELECT *, {weight} AS w FROM hashed),
    sums AS (SELECT replicate, {sums} FROM weighed GROUP BY replicate)"""


def _robust_points() -> str:
    """Weighted means of the raw points, step by step."""
    steps = [
        """,
    raw AS (SELECT geolocation_zip_code_prefix AS zip_prefix, geolocation_lat AS x, geolocation_lng AS y FROM b_geolocation
            WHERE geolocation_lat IS NOT NULL AND geolocation_lng IS NOT NULL),
    p0 AS (SELECT zip_prefix, avg(x) AS lat, avg(y) AS lng FROM raw GROUP BY 1)"""
    ]
    for i in range(POINT_STEPS):
        steps.append(f"""
    w{i} AS (SELECT *, 1 / greatest(sqrt((x - lat) ** 2 + (y - lng) ** 2), {NEAREST}) AS w FROM raw JOIN p{i} USING (zip_prefix)),
    p{i + 1} AS (SELECT zip_prefix, sum(w * x) / sum(w) AS lat, sum(w * y) / sum(w) AS lng, count(*) AS n FROM w{i} GROUP BY 1)""")
    return ",".join(steps) + f" SELECT zip_prefix, round(lat, 6) AS lat, round(lng, 6) AS lng, n FROM p{POINT_STEPS}"


_BOUNDS_OF = """round(v[1 + round_even((len(v) - 1) * 0.025, 0)::INT], 6) AS low,
           round(v[1 + round_even((len(v) - 1) * (1 - 0.05 / 2), 0)::INT], 6) AS high"""

# Exact binomial sums over the counts 0 to n of every city.
_FUNNEL = """,
    g AS (SELECT customer_city, count(*) AS n, CAST(sum(CAST(is_late AS INT)) AS BIGINT) AS late
          FROM features WHERE customer_city IS NOT NULL GROUP BY 1),
    b AS (SELECT *, (SELECT sum(late) / sum(n)::DOUBLE FROM g) AS baseline FROM g),
    c AS (SELECT *, unnest(range(n + 1)) AS c FROM b),
    d AS (SELECT *, exp(lgamma(n + 1) - lgamma(c + 1) - lgamma(n - c + 1) + c * ln(baseline) + (n - c) * ln(1 - baseline)) AS mass FROM c),
    t AS (SELECT *, sum(mass) OVER (PARTITION BY customer_city ORDER BY c) AS up_to,
                 sum(mass) OVER (PARTITION BY customer_city ORDER BY c DESC) AS onwards FROM d),
    v AS (SELECT customer_city, n, late, baseline,
                 least(1, 2 * least(max(CASE WHEN c = late THEN up_to END), max(CASE WHEN c = late THEN onwards END))) AS p_value,
                 min(CASE WHEN up_to > 0.025 THEN c END) / n AS low_rate, max(CASE WHEN onwards > 0.025 THEN c END) / n AS high_rate
          FROM t GROUP BY customer_city, n, late, baseline),
    r AS (SELECT *, count(*) OVER (ORDER BY round(p_value, 12)) AS rank, count(*) OVER () AS m FROM v),
    q AS (SELECT *, least(1, min(p_value * m / rank) OVER (ORDER BY rank RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM r)
    SELECT customer_city, n, late, round(baseline, 6) AS baseline, round(late / n, 6) AS late_rate, round(p_value, 6) AS p_value,
           CAST(rank AS BIGINT) AS rank, round(q_value, 6) AS q_value, round(low_rate, 6) AS low_rate, round(high_rate, 6) AS high_rate,
           CASE WHEN q_value > 0.05 THEN 'no' WHEN late / n > baseline THEN 'high' ELSE 'low' END AS outlier
    FROM q"""


def _city_identities() -> str:
    """All pairs of names are compared; chains of links are followed by doubling."""
    doubled = [f"e{i} AS (SELECT a.name, b.goal FROM e{i - 1} a JOIN e{i - 1} b ON a.goal = b.name)" for i in range(1, 6)]
    return f""",
    spellings AS (SELECT customer_city AS city, count(*) AS n,
                         trim(regexp_replace(strip_accents(lower(customer_city)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name
                  FROM (SELECT concat(n_name, '-', c_mktsegment) AS customer_city FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE customer_city IS NOT NULL GROUP BY customer_city),
    names AS (SELECT name, sum(n) AS n, list_extract(list(city ORDER BY n DESC, city), 1) AS spelling,
                     CASE WHEN length(name) < 5 THEN 0 WHEN length(name) < 10 THEN 1 ELSE 2 END AS edits,
                     regexp_replace(name, '\\P{{N}}+', '', 'g') AS digits
              FROM spellings GROUP BY name),
    targets AS (SELECT a.name, list_extract(list(b.name ORDER BY levenshtein(a.name, b.name), b.n DESC, b.name), 1) AS target
                FROM names a JOIN names b ON a.digits = b.digits AND b.n >= 10 * a.n
                     AND levenshtein(a.name, b.name) <= least(a.edits, b.edits) GROUP BY a.name),
    e0 AS (SELECT name, coalesce(target, name) AS goal FROM names LEFT JOIN targets USING (name)),
    {", ".join(doubled)}
    SELECT city, spellings.n, spelling AS canonical
    FROM spellings JOIN e5 USING (name) JOIN names ON names.name = e5.goal"""


def _shrunk() -> str:
    """The prior's Newton steps over sums of reciprocals, and the interval by halving over binomial-like sums."""
    steps = []
    for i in range(outliers.STEPS):
        steps.append(f"""
    a{i} AS (SELECT any_value(u) AS u, any_value(s) AS s,
        sum(w * list_sum([1 / (u * s + i) for i in range(late)])) AS a1, sum(w * list_sum([1 / ((1 - u) * s + i) for i in range(n - late)])) AS b1,
        sum(w * list_sum([1 / (s + i) for i in range(n)])) AS c1,
        -sum(w * list_sum([1 / (u * s + i) ** 2 for i in range(late)])) AS a2, -sum(w * list_sum([1 / ((1 - u) * s + i) ** 2 for i in range(n - late)])) AS b2,
        -sum(w * list_sum([1 / (s + i) ** 2 for i in range(n)])) AS c2
        FROM pairs, p{i}),
    d{i} AS (SELECT *, s * u * (1 - u) AS v, coalesce(a1, 0) - c1 AS x, coalesce(b1, 0) - c1 AS y, coalesce(a2, 0) AS a3, coalesce(b2, 0) AS b3 FROM a{i}),
    h{i} AS (SELECT *, v * (x - y) AS gm, u * s * x + (1 - u) * s * y AS gs, v * v * (a3 + b3) + v * (1 - 2 * u) * (x - y) AS hm,
        (u * s) ** 2 * a3 + ((1 - u) * s) ** 2 * b3 - s * s * c2 + u * s * x + (1 - u) * s * y AS hs,
        v * (u * s * a3 - (1 - u) * s * b3) + v * (x - y) AS hb FROM d{i}),
    m{i} AS (SELECT u, s,
        CASE WHEN hm < 0 AND s >= {outliers.STRONGEST} THEN -gm / hm WHEN hm < 0 AND hm * hs > hb * hb THEN (hb * gs - hs * gm) / (hm * hs - hb * hb) WHEN hm < 0 THEN -gm / hm ELSE 0 END AS mu,
        CASE WHEN hm < 0 AND hm * hs > hb * hb THEN (hb * gm - hm * gs) / (hm * hs - hb * hb)
             WHEN gs < 0 THEN -{outliers.LONGEST_STEP} ELSE {outliers.LONGEST_STEP} END AS ms FROM h{i}),
    p{i + 1} AS (SELECT 1 / (1 + exp(-(ln(u / (1 - u)) + least(greatest(mu, -{outliers.LONGEST_STEP}), {outliers.LONGEST_STEP})))) AS u,
        least(greatest(s * exp(least(greatest(ms, -{outliers.LONGEST_STEP}), {outliers.LONGEST_STEP})), {outliers.WEAKEST}), {outliers.STRONGEST}::DOUBLE) AS s FROM m{i})""")
    # The posterior is added up over a fine grid of the logit of the rate.
    return (
        """,
    g AS (SELECT customer_city, count(*) AS n, CAST(sum(CAST(is_late AS INT)) AS BIGINT) AS late
          FROM features WHERE customer_city IS NOT NULL GROUP BY 1),
    pairs AS (SELECT n, late, count(*) AS w FROM g GROUP BY ALL),
    p0 AS (SELECT (sum(late * w) + 0.5) / (sum(n * w) + 1.0)::DOUBLE AS u, 10.0::DOUBLE AS s FROM pairs),"""
        + ",".join(steps)
        + f""",
    post AS (SELECT g.*, u, s, u * s + late AS a, (1 - u) * s + n - late AS b FROM g, p{outliers.STEPS}),
    o AS (SELECT *, ln(a / b) AS centre, sqrt(1 / a + 1 / b) AS width, lgamma(a + b) - lgamma(a) - lgamma(b) AS front FROM post),
    grid AS (SELECT *, centre + width * (k - 6000) / 500 AS z FROM (SELECT *, unnest(range(12001)) AS k FROM o)),
    f AS (SELECT *, width / 500 * exp(front - a * ln(1 + exp(-z)) - b * ln(1 + exp(z))) AS mass FROM grid),
    cum AS (SELECT *, sum(mass) OVER (PARTITION BY customer_city ORDER BY k) - mass / 2 AS up_to FROM f),
    ends AS (SELECT *, lead(up_to) OVER w AS next_up, lead(z) OVER w AS next_z, lead(mass) OVER w AS next_mass FROM cum WINDOW w AS (PARTITION BY customer_city ORDER BY k)),
    cut AS (SELECT *, (q - up_to) / ((mass + next_mass) / 2) AS t0, (next_mass - mass) / (mass + next_mass) AS tilt
            FROM ends, (VALUES (0.025), (0.975)) AS qs(q) WHERE up_to <= q AND next_up > q),
    -- Inside a step the density is taken as linear.
    solved AS (SELECT customer_city, q, z + (next_z - z) * (t0 + tilt * t0 * (1 - t0)) AS edge FROM cut)
    SELECT customer_city, n, late, round(late / n, 6) AS late_rate, round(u, 6) AS prior_mean, round(ln(s), 3) AS log_strength,
           round((u * s + late) / (s + n), 6) AS shrunk_rate,
           round((SELECT 1 / (1 + exp(-edge)) FROM solved x WHERE x.customer_city = post.customer_city AND q < 0.5), 4) AS low,
           round((SELECT 1 / (1 + exp(-edge)) FROM solved x WHERE x.customer_city = post.customer_city AND q > 0.5), 4) AS high
    FROM post"""
    )


def oracle_sql() -> dict[str, str]:
    themes, severities = _array(THEMES), _array(SEVERITIES)
    answered = f"""
        SELECT CAST(review_id AS VARCHAR) AS review_id,
               CASE WHEN review_id % 9 = 8 THEN 'other' ELSE {themes}[review_id % 9 + 1] END AS theme,
               {severities}[review_id % 3 + 1] AS severity"""
    bodies = {
        "bronze_counts": _counts(
            {
                name: f"b_{name}"
                for name in (
                    "orders",
                    "order_reviews",
                    "order_items",
                    "order_payments",
                    "customers",
                    "geolocation",
                )
            }
        ),
        "silver_counts": _counts(
            {
                "orders_clean": "s_orders",
                "reviews_dedup": "s_reviews",
                "order_items_agg": "s_items",
                "order_payments_agg": "s_payments",
                "geolocation_centroid": "s_points",
            }
        ),
        "sql_sum": "SELECT CAST(sum(payment_installments) AS BIGINT) AS s FROM b_order_payments",
        "column_sum": "SELECT CAST(sum(payment_installments) AS BIGINT) AS s FROM b_order_payments",
        "review_key_profile": """
            SELECT count(*) AS n_rows, count(DISTINCT review_id) AS n_review_ids,
                   count(review_comment_message) AS n_with_text FROM b_order_reviews""",
        "excluded_status_breakdown": """
            SELECT order_status, count(*) AS n_orders FROM b_orders
            WHERE order_delivered_customer_date IS NULL GROUP BY order_status""",
        "orders_clean": "SELECT * FROM s_orders",
        "reviews_dedup": "SELECT * FROM s_reviews",
        "order_items_agg": "SELECT * FROM s_items",
        "order_payments_agg": "SELECT * FROM s_payments",
        "geolocation_centroid": """
            SELECT zip_prefix, round(lat, 6) AS lat, round(lng, 6) AS lng, geo_state FROM s_points""",
        "gold_reviews": f"SELECT {_GOLD_COLUMNS} FROM gold",
        "gold_single_statement": f"""
            SELECT * REPLACE (CAST(has_text AS INTEGER) AS has_text)
            FROM (SELECT {_GOLD_COLUMNS} FROM gold)""",
        "gold_grain_check": """
            SELECT count(*) AS n_rows, count(DISTINCT review_id) AS n_review_ids,
                   count(*) = count(DISTINCT review_id) AS is_unique FROM gold""",
        "review_features": f"SELECT {_FEATURE_COLUMNS} FROM features",
        "features_from_statement": """
            SELECT review_id, has_text, delivery_gap_days, is_late, delivery_outcome, is_negative
            FROM features""",
        "score_by_outcome": _SCORE_BY_OUTCOME,
        "headline_rates": """
            SELECT count(*) AS n_reviews, round_even(avg(is_late::INT) * 100, 1) AS late_pct,
                   round_even(avg(is_negative::INT) * 100, 1) AS negative_pct FROM features""",
        "one_time_buyers": """
            SELECT count(*) AS n_customers,
                   CAST(round(100.0 * count(*) FILTER (n = 1) / count(*), 1) AS DOUBLE) AS one_time_pct
            FROM (SELECT customer_unique_id, count(*) AS n
                  FROM b_orders JOIN b_customers USING (customer_id) GROUP BY 1)""",
        "score_share_by_outcome": """
            SELECT a.delivery_outcome, a.review_score, count(*) AS n,
                   count(*) / (SELECT count(*) FROM features b
                               WHERE b.delivery_outcome = a.delivery_outcome) AS proportion
            FROM features a GROUP BY 1, 2""",
        "gap_histogram_daily": _DAILY,
        "gap_histogram_equal_width": _EQUAL_WIDTH,
        "model_sentiment": "SELECT review_id, star_a, label_a FROM sentiment",
        "lexicon_sentiment": "SELECT review_id, compound_b, label_b FROM sentiment",
        "sentiment_labels": f"SELECT {_SENTIMENT_COLUMNS} FROM sentiment",
        "sentiment_summary": _SUMMARY,
        "sentiment_disagreements": f"""
            SELECT {_SENTIMENT_COLUMNS}, review_comment_message FROM sentiment WHERE NOT ab_agree""",
        "disagreement_examples": """
            SELECT review_id, review_score, label_a, label_b,
                   review_comment_message AS excerpt
            FROM sentiment WHERE NOT ab_agree
            ORDER BY md5(CAST(review_id AS VARCHAR) || ':1'), review_id LIMIT 3""",
        "negative_sample": "SELECT * FROM sample",
        "all_negatives_ranked": "SELECT review_id, rank FROM ranked",
        "negative_half_sample": "SELECT * FROM half_sample",
        "theme_batches": _BLOCKS.format(text="review_comment_message", source="ranked"),
        "theme_batches_whole_text": _BLOCKS.format(text="review_comment_message", source="ranked"),
        "theme_batches_short": _BLOCKS.format(
            text="substring(review_comment_message, 1, 400)", source="half_sample"
        ),
        "theme_coverage": """
            SELECT count(*) AS asked, count(*) FILTER (review_id % 5 <> 0) AS labelled,
                   count(*) FILTER (review_id % 5 = 0) AS missing,
                   CAST(ceil(count(*) / 25.0) + ceil(count(*) FILTER (review_id % 5 = 0) / 25.0) AS BIGINT) AS "foreign"
            FROM ranked""",
        "label_new_reviews": f"""
            SELECT CAST(review_id AS VARCHAR) AS review_id,
                   {themes}[CASE WHEN rank > 150 AND review_id % 10 = 3 THEN (review_id + 1) % 8
                                 ELSE review_id % 8 END + 1] AS theme,
                   {severities}[review_id % 3 + 1] AS severity FROM ranked""",
        "labelled_stability": """
            SELECT count(*) AS n_both, avg((review_id % 10 <> 3)::INT) AS stability FROM ranked""",
        "gold_by_name": """
            SELECT g.review_id, g.order_id, g.review_score, g.has_text, g.customer_city, g.n_items,
                   p.payment_total, p.n_payments
            FROM gold g LEFT JOIN s_payments p ON p.order_id = g.order_id""",
        "theme_parse": f"""
            SELECT CAST(review_id AS VARCHAR) AS review_id,
                   CASE WHEN review_id % 9 < 7 THEN {themes}[review_id % 9 + 1] ELSE 'other' END AS theme,
                   {severities}[review_id % 3 + 1] AS severity
            FROM raw_negatives WHERE (review_id // 25) % 4 <> 3""",
        "themes": f"{answered} FROM ranked",
        "theme_stability": _STABILITY,
        "theme_counts": "SELECT theme, count(*) AS n FROM run_a GROUP BY theme",
        "theme_examples": """
            SELECT theme, review_comment_message AS example FROM joined
            WHERE review_comment_message IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY theme ORDER BY CAST(review_id AS VARCHAR)) = 1""",
        "theme_frequency": """,
            totals AS (SELECT theme, count(*) AS theme_total FROM joined GROUP BY theme),
            ranks AS (SELECT *, row_number() OVER (ORDER BY theme_total DESC, theme) AS theme_rank
                      FROM totals),
            examples AS (
                SELECT theme, arg_min(review_comment_message,
                                      CAST(review_id AS VARCHAR)) AS example
                FROM joined WHERE review_comment_message IS NOT NULL GROUP BY theme)
            SELECT theme, delivery_outcome, count(*) AS n, theme_total,
                   CAST(theme_rank AS INTEGER) AS theme_rank, example
            FROM joined JOIN ranks USING (theme) LEFT JOIN examples USING (theme)
            WHERE delivery_outcome IS NOT NULL
            GROUP BY ALL""",
        "theme_outcome_pivot": """
            SELECT theme,
                   CASE theme WHEN 'wrong_or_missing_item' THEN 'Wrong / Missing Item'
                              WHEN 'never_arrived' THEN 'Never Arrived'
                              WHEN 'late_delivery' THEN 'Late Delivery'
                              WHEN 'damaged_product' THEN 'Damaged Product'
                              WHEN 'not_as_described' THEN 'Not as Described'
                              WHEN 'poor_quality' THEN 'Poor Quality'
                              WHEN 'refund_or_billing' THEN 'Refund / Billing'
                              WHEN 'other' THEN 'Other' END AS display_name,
                   count(*) FILTER (coalesce(delivery_outcome, 'On-time') = 'On-time') AS n_on_time,
                   count(*) FILTER (delivery_outcome = 'Late') AS n_late,
                   count(*) AS total
            FROM joined GROUP BY theme""",
        "theme_summary": f"""
            SELECT (SELECT count(*) FROM run_a) AS n,
                   (SELECT round_even(stability * 100, 1) FROM ({_STABILITY})) AS stability_pct,
                   (SELECT {_FREQUENCY_JSON.format(labels='run_a')}) AS freq""",
        "city_lateness": f"""
            SELECT customer_city, count(*) AS n, round(avg(is_late::INT), 6) AS late_rate,
                   round(avg(review_score), 6) AS avg_score, round({_mean('lat')}, 6) AS lat,
                   round({_mean('lng')}, 6) AS lng, min(customer_state) AS state,
                   CAST(round_even(avg(is_late::INT) * 100, 1) AS VARCHAR) || '%' AS late_pct,
                   CAST(round_even(avg(review_score), 2) AS VARCHAR) AS avg_score_str
            FROM features WHERE customer_city IS NOT NULL GROUP BY customer_city
            HAVING count(*) >= {CITY_MIN_ORDERS} AND avg(lat) IS NOT NULL""",
        "gap_quantiles": """
            SELECT delivery_outcome, n, share, round(list_extract(q, i), 8) AS gap_days
            FROM (SELECT delivery_outcome, count(delivery_gap_days) AS n, quantile_cont(delivery_gap_days, [0.25, 0.5, 0.75]) AS q
                  FROM features GROUP BY 1), (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE)) s(i, share)""",
        "score_difference_interval": ","
        + _replicates(
            "features",
            "sum(w * (NOT is_late)::INT * review_score) / nullif(sum(w * (NOT is_late)::INT), 0)"
            " - sum(w * is_late::INT * review_score) / nullif(sum(w * is_late::INT), 0) AS value",
        )
        + f""",
            v AS (SELECT list_sort(list(value)) AS v FROM sums WHERE value IS NOT NULL)
            SELECT (SELECT count(review_score) FROM features) AS n,
                   round((SELECT avg(review_score) FILTER (NOT is_late) - avg(review_score) FILTER (is_late) FROM features), 6) AS difference,
                   {_BOUNDS_OF} FROM v""",
        "stability_interval": """,
            both_runs AS (SELECT run_a.review_id, (run_a.theme = run_b.theme)::INT AS same FROM run_a JOIN run_b USING (review_id)),"""
        + _replicates("both_runs", "sum(w * same) / nullif(sum(w), 0) AS value")
        + f""",
            v AS (SELECT list_sort(list(value)) AS v FROM sums WHERE value IS NOT NULL)
            SELECT (SELECT count(*) FROM both_runs) AS n, round((SELECT avg(same) FROM both_runs), 6) AS mean, {_BOUNDS_OF} FROM v""",
        "stratified_negative_sample": """,
            pool AS (SELECT review_id, review_comment_message, CASE WHEN is_late THEN 'Late' ELSE 'On-time' END AS stratum
                     FROM features WHERE is_negative AND has_text),
            sizes AS (SELECT stratum, count(*) AS size, sum(count(*)) OVER () AS total FROM pool GROUP BY 1),
            shares AS (SELECT *, 150 * size // total AS whole, row_number() OVER (ORDER BY 150 * size % total DESC, stratum) AS place FROM sizes),
            quotas AS (SELECT stratum, CASE WHEN total <= 150 THEN size
                              ELSE whole + (place <= 150 - sum(whole) OVER ())::INT END AS quota FROM shares),
            placed AS (SELECT *, row_number() OVER (PARTITION BY stratum
                                                    ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rank FROM pool)
            SELECT review_id, stratum, CAST(quota AS BIGINT) AS quota, rank, review_comment_message
            FROM placed JOIN quotas USING (stratum) WHERE rank <= quota""",
        "zip_points_robust": _robust_points(),
        "city_identities": _city_identities(),
        "city_lateness_shrunk": _shrunk(),
        "city_funnel": _FUNNEL,
        "staged_features": f"SELECT {_FEATURE_COLUMNS} FROM features",
        "gold_after_deltas": f"SELECT {_GOLD_COLUMNS} FROM gold",
        "cache_roundtrip": "SELECT * FROM s_payments",
        "cache_follows_inputs": """
            SELECT order_id, CAST(sum(payment_value) AS DOUBLE) AS payment_total,
                   count(*) AS n_payments, max(payment_installments) AS max_installments
            FROM b_order_payments WHERE payment_installments > 1 GROUP BY order_id""",
        "csv_reviews_in_blocks": """
            SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id, review_score,
                   review_comment_title, review_comment_message, review_answer_timestamp
            FROM b_order_reviews""",
        # Ids and zip prefixes are strings in CSV files.
        "csv_gold": f"""
            SELECT * REPLACE (CAST(review_id AS VARCHAR) AS review_id,
                              CAST(order_id AS VARCHAR) AS order_id,
                              CAST(customer_zip_code_prefix AS VARCHAR) AS customer_zip_code_prefix)
            FROM (SELECT {_GOLD_COLUMNS} FROM gold)""",
        "parquet_score_by_outcome": _SCORE_BY_OUTCOME,
        "catalog_score_by_outcome": _SCORE_BY_OUTCOME,
        "sentiment_job": _SUMMARY,
        "analysis_score_by_outcome": _SCORE_BY_OUTCOME,
        "analysis_theme_counts": f""",
            answered AS ({answered} FROM ranked)
            SELECT theme, count(*) AS n FROM answered GROUP BY theme""",
        "theming_chart": f""",
            answered AS ({answered} FROM ranked),
            met AS (SELECT a.theme, CASE WHEN f.is_late THEN 'Late' ELSE 'On-time' END AS delivery_outcome
                    FROM answered a JOIN features f ON CAST(f.review_id AS VARCHAR) = a.review_id),
            totals AS (SELECT theme, count(*) AS theme_total FROM answered GROUP BY theme),
            ranks AS (SELECT *, row_number() OVER (ORDER BY theme_total DESC, theme) AS r FROM totals),
            rows AS (SELECT theme, delivery_outcome, count(*) AS n, theme_total, CAST(r AS INTEGER) AS theme_rank
                     FROM met JOIN ranks USING (theme) GROUP BY ALL)
            SELECT *, CAST(row_number() OVER (
                       ORDER BY theme_rank, CASE delivery_outcome WHEN 'On-time' THEN 0 ELSE 1 END) AS INTEGER) AS place
            FROM rows""",
        "theming_job": f""",
            answered AS ({answered} FROM ranked)
            SELECT count(*) AS n,
                   (SELECT round_even(100.0 * avg((theme = {themes}[CASE WHEN review_id::BIGINT % 10 = 3
                                                       THEN (review_id::BIGINT + 1) % 8 ELSE review_id::BIGINT % 8 END + 1])::INT), 1)
                    FROM answered) AS stability_pct,
                   (SELECT {_FREQUENCY_JSON.format(labels='answered')}) AS freq
            FROM answered""",
    }
    return {name: _with(body) for name, body in bodies.items()}
