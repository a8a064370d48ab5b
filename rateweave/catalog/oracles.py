"""SQL twins of the registered queries, for any engine that reads the driver tables.

They follow the definitions row by row (every event, every pair of co-ratings) and share no
code with the operators. Numbers that are not whole are rounded to six places.
"""

from __future__ import annotations

from rateweave.catalog.inputs import NEW_BRAND, NEW_NATION, NEW_SUPPLIER_NATION, REQUESTS_FROM, VAL_FROM


def _bag(dense: bool) -> str:
    item = "l.l_suppkey" if dense else "l.l_partkey"
    launch = (
        f"LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = {NEW_SUPPLIER_NATION}"
        if dense
        else f"LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_brand = '{NEW_BRAND}'"
    )
    launched = "s.s_suppkey" if dense else "p.p_partkey"
    return f"""
        SELECT o.o_custkey AS user_id, {item} AS item_id,
               CAST(1 + CAST(l.l_quantity AS INTEGER) % 5 AS DOUBLE) AS stars,
               CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS rated_on,
               l.l_orderkey AS ord1, l.l_linenumber AS ord2, l.l_shipdate AS ord3, l.l_quantity AS ord4,
               CASE WHEN c.c_custkey IS NOT NULL OR {launched} IS NOT NULL
                         OR o.o_orderdate >= TIMESTAMP '{REQUESTS_FROM} 00:00:00' THEN 'request'
                    WHEN o.o_orderdate >= TIMESTAMP '{VAL_FROM} 00:00:00' THEN 'val'
                    ELSE 'train' END AS period
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_nationkey = {NEW_NATION}
        {launch}"""


_CASE = """
    CASE WHEN n IS NULL THEN 'no_co_raters'
         WHEN n = 1 AND sx > m AND sy > m THEN 'one_both_above'
         WHEN n = 1 AND sx < m AND sy < m THEN 'one_both_below'
         WHEN n = 1 THEN 'one_mixed'
         WHEN n <= 3 THEN 'two_or_three'
         WHEN n * sxx - sx * sx = 0 OR n * syy - sy * sy = 0 THEN 'no_variance'
         WHEN n * sxy - sx * sy = 0 THEN 'no_covariance'
         ELSE 'pearson' END"""
_PEARSON = """
    least(1.0, greatest(-1.0, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy))))"""


def _top(order: str) -> str:
    return f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY {order}, neighbor_id) AS rn FROM weights
        ) WHERE rn <= 20"""


# Name -> (SQL, names it needs).
_PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "bag": (_bag(dense=False), ()),
    "train": ("SELECT * FROM bag WHERE period = 'train'", ("bag",)),
    "val": ("SELECT * FROM bag WHERE period = 'val'", ("bag",)),
    "events_all": ("SELECT * FROM bag WHERE period IN ('train', 'val')", ("bag",)),
    "requests": ("SELECT user_id, item_id FROM bag WHERE period = 'request'", ("bag",)),
    "pairs": ("SELECT DISTINCT user_id, item_id FROM requests", ("requests",)),
    "last_rating": ("""
        SELECT user_id, item_id, stars FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                                         ORDER BY ord1 DESC, ord2 DESC, ord3 DESC, ord4 DESC) AS rn FROM events_all
        ) WHERE rn = 1""", ("events_all",)),
    "last_review": ("""
        SELECT user_id, item_id, stars FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, item_id
                                         ORDER BY ord1 DESC, ord2 DESC, ord3 DESC, ord4 DESC) AS rn FROM train
        ) WHERE rn = 1""", ("train",)),
    "mu": ("SELECT avg(stars) AS m FROM last_rating", ("last_rating",)),
    "user_stats": ("SELECT user_id, avg(stars) AS um, count(*) AS un FROM events_all GROUP BY user_id", ("events_all",)),
    "item_stats": ("SELECT item_id, avg(stars) AS im, count(*) AS cnt FROM events_all GROUP BY item_id", ("events_all",)),
    "classed": ("""
        SELECT p.user_id, p.item_id, um, un, im, cnt,
               CASE WHEN un IS NULL AND cnt IS NULL THEN 'unknown_both' WHEN un IS NULL THEN 'unknown_user'
                    WHEN cnt IS NULL THEN 'unknown_item' ELSE 'known' END AS cold_class
        FROM pairs p LEFT JOIN user_stats u ON u.user_id = p.user_id LEFT JOIN item_stats i ON i.item_id = p.item_id""",
        ("pairs", "user_stats", "item_stats")),
    "cand": ("""
        SELECT c.user_id, c.item_id, e.item_id AS neighbor_id, r.stars AS neighbor_stars
        FROM classed c JOIN events_all e ON e.user_id = c.user_id
        JOIN last_rating r ON r.user_id = e.user_id AND r.item_id = e.item_id
        WHERE c.cold_class = 'known'""", ("classed", "events_all", "last_rating")),
    "co": ("""
        SELECT a.item_id AS i, b.item_id AS j, count(*) AS n, sum(a.stars) AS sx, sum(b.stars) AS sy,
               sum(a.stars * b.stars) AS sxy, sum(a.stars * a.stars) AS sxx, sum(b.stars * b.stars) AS syy
        FROM last_rating a JOIN last_rating b ON a.user_id = b.user_id GROUP BY a.item_id, b.item_id""",
        ("last_rating",)),
    "ruled": (f"""
        SELECT c.*, coalesce(n, 0) AS co_raters, n, sx, sy, sxy, sxx, syy, {_CASE} AS rule
        FROM cand c CROSS JOIN mu LEFT JOIN co ON co.i = c.item_id AND co.j = c.neighbor_id""",
        ("cand", "mu", "co")),
    "weights": (f"""
        SELECT user_id, item_id, neighbor_id, neighbor_stars, co_raters, rule,
               CASE rule WHEN 'no_co_raters' THEN 0.65::DOUBLE WHEN 'one_both_above' THEN 0.75::DOUBLE
                         WHEN 'one_both_below' THEN 0.8::DOUBLE WHEN 'one_mixed' THEN 0.35::DOUBLE
                         WHEN 'two_or_three' THEN 0.65::DOUBLE WHEN 'no_variance' THEN 0.7::DOUBLE
                         WHEN 'no_covariance' THEN 0.95::DOUBLE ELSE {_PEARSON} END AS w
        FROM ruled""", ("ruled",)),
    "best": (_top("w DESC"), ("weights",)),
    "best_abs": (_top("abs(w) DESC"), ("weights",)),
    "best_signed": (_top("(w > 0) DESC, CASE WHEN w > 0 THEN -w ELSE w END"), ("weights",)),
    "trust": ("""
        SELECT user_id, item_id,
               count(CASE WHEN w NOT IN (0.65::DOUBLE, 0.75::DOUBLE, 0.8::DOUBLE, 0.35::DOUBLE, 0.7::DOUBLE, 0.95::DOUBLE)
                          THEN 1 END) AS n_computed
        FROM weights GROUP BY user_id, item_id""", ("weights",)),
    "scored": ("""
        SELECT b.user_id, b.item_id,
               sum(((CASE WHEN w < 0 THEN 6 - neighbor_stars ELSE neighbor_stars END) - s.im)
                   * abs(w) * abs(w) * sqrt(abs(w))) AS num,
               sum(abs(w) * abs(w) * sqrt(abs(w))) AS den
        FROM best b JOIN item_stats s ON s.item_id = b.neighbor_id GROUP BY b.user_id, b.item_id""",
        ("best", "item_stats")),
    "cf": ("""
        SELECT c.user_id, c.item_id,
               CASE WHEN cold_class <> 'known' THEN cold_class WHEN den = 0 THEN 'zero_weights' ELSE 'neighbors' END AS cf_case,
               least(5.0, greatest(1.0,
                   CASE cold_class WHEN 'unknown_both' THEN m WHEN 'unknown_user' THEN im WHEN 'unknown_item' THEN um
                        ELSE CASE WHEN den = 0 THEN (im * cnt + um * un) / (cnt + un) ELSE num / den + im END END)) AS cf,
               cold_class = 'known' AND den <> 0 AND n_computed >= 2 AS trusted
        FROM classed c CROSS JOIN mu
        LEFT JOIN scored s ON s.user_id = c.user_id AND s.item_id = c.item_id
        LEFT JOIN trust t ON t.user_id = c.user_id AND t.item_id = c.item_id""",
        ("classed", "mu", "scored", "trust")),
    "users": ("""
        SELECT c.c_custkey AS user_id, n.n_name AS name,
               CASE WHEN c.c_acctbal < 0 THEN 0.0::DOUBLE
                    ELSE 1 + CAST(floor(c.c_acctbal / 25) AS DOUBLE) / 100 END AS average_stars,
               (c.c_custkey * 13) % 97 AS review_count,
               CAST(DATE '2010-01-01' + CAST((c.c_custkey * 17) % 2500 AS INTEGER) AS VARCHAR) AS member_since,
               c.c_custkey % 7 AS fans, e.funny, e.useful, e.cool,
               c.c_custkey % 5 AS compliment_hot, c.c_custkey % 4 AS compliment_note,
               CASE WHEN c.c_custkey % 6 = 0 THEN 'None' WHEN c.c_custkey % 31 = 0 THEN ''
                    ELSE concat_ws(', ', CAST(c.c_custkey + 1 AS VARCHAR), CAST(c.c_custkey + 5 AS VARCHAR),
                                   CAST(c.c_custkey * 2 + 1 AS VARCHAR)) END AS friends
        FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN (SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS funny,
                          count(CASE WHEN event_type = 'view' THEN 1 END) AS useful,
                          count(CASE WHEN event_type = 'purchase' THEN 1 END) AS cool
                   FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey""", ()),
    "items": ("""
        SELECT p_partkey AS item_id,
               CASE WHEN p_size = 50 THEN 0.0::DOUBLE ELSE CAST(2 + p_size % 9 AS DOUBLE) / 2 END AS stars,
               p_size AS review_count, p_size % 2 AS is_open,
               CASE WHEN p_brand <> 'Brand#2' THEN p_retailprice / 50 END AS latitude,
               CASE WHEN p_brand <> 'Brand#2' THEN CAST(-2 * p_size AS DOUBLE) END AS longitude,
               CASE p_size % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS good_for_kids,
               CASE p_size % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS good_for_groups,
               CASE p_size % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'free' WHEN 2 THEN 'paid' END AS wifi,
               CASE WHEN p_size % 6 < 4 THEN CAST(p_size % 6 + 1 AS VARCHAR) END AS price_range
        FROM part""", ()),
    "hours": ("""
        SELECT p_partkey AS item_id, d.day,
               CAST((p_size + d.day) % 12 AS VARCHAR) || ':' || CAST(30 * (d.day % 2) AS VARCHAR) AS opens_at,
               CAST((p_partkey + d.day) % 3 * 9 + 3 AS VARCHAR) || ':0' AS closes_at
        FROM part CROSS JOIN (SELECT unnest(range(7)) AS day) d
        WHERE p_size % 3 <> 0 AND (p_size + d.day) % 5 <> 0""", ()),
    "checkin": ("""
        SELECT l_partkey AS item_id, day(l_shipdate) AS slot, count(*) AS n
        FROM lineitem GROUP BY l_partkey, day(l_shipdate)""", ()),
    "lookup": ("""
        SELECT lower(n_name) AS lookup_key, CASE WHEN n_regionkey < 2 THEN 'F' WHEN n_regionkey = 4 THEN 'U' ELSE 'M' END AS code
        FROM nation""", ()),
    "open_close": ("""
        SELECT item_id, count(*) AS days_open,
               avg(CAST(replace(opens_at, ':', '.') AS DOUBLE)) AS opening_time
        FROM hours GROUP BY item_id""", ("hours",)),
    "close_freq": ("""
        SELECT item_id, CAST(replace(closes_at, ':', '.') AS DOUBLE) AS v, count(*) AS k
        FROM hours GROUP BY item_id, v""", ("hours",)),
    "close_mode": ("""
        SELECT item_id, CASE WHEN min(v) <= 6 THEN min(v) ELSE max(v) END AS closing_time
        FROM close_freq f WHERE k = (SELECT max(k) FROM close_freq g WHERE g.item_id = f.item_id)
        GROUP BY item_id""", ("close_freq",)),
    "close_global": ("""
        SELECT CASE WHEN min(v) <= 6 THEN min(v) ELSE max(v) END AS closing_mode FROM (
            SELECT closing_time AS v, count(*) AS k FROM close_mode WHERE closing_time <> 0 GROUP BY closing_time)
        WHERE k = (SELECT max(k) FROM (SELECT count(*) AS k FROM close_mode WHERE closing_time <> 0
                                       GROUP BY closing_time))""", ("close_mode",)),
    "edges": ("""
        SELECT user_id, TRY_CAST(unnest(string_split(friends, ', ')) AS BIGINT) AS friend_id
        FROM users WHERE friends IS NOT NULL AND friends <> 'None'""", ("users",)),
    "friend_rated": ("""
        SELECT q.user_id, q.item_id, avg(r.stars) AS mean_stars, count(*) AS n
        FROM wanted q JOIN edges e ON e.user_id = q.user_id
        JOIN last_review r ON r.user_id = e.friend_id AND r.item_id = q.item_id
        GROUP BY q.user_id, q.item_id""", ("wanted", "edges", "last_review")),
    "friend_profile": ("""
        SELECT e.user_id, avg(f.average_stars) AS friend_mean
        FROM edges e JOIN users f ON f.user_id = e.friend_id GROUP BY e.user_id""", ("edges", "users")),
    "wanted": ("SELECT DISTINCT user_id, item_id FROM requests", ("requests",)),
    "date_var": ("""
        SELECT user_id, count(*) AS user_events,
               coalesce(var_samp(CAST(replace(rated_on, '-', '') AS INTEGER)), 0) AS date_var
        FROM train GROUP BY user_id""", ("train",)),
    "item_events": ("SELECT item_id, count(*) AS item_events FROM train GROUP BY item_id", ("train",)),
    "slots": ("SELECT item_id, count(*) AS checkin_slots FROM checkin GROUP BY item_id", ("checkin",)),
    "friend_counts": ("""
        SELECT user_id, CASE WHEN friends IN ('', 'None') THEN 0 ELSE len(string_split(friends, ', ')) END AS friend_count
        FROM users""", ("users",)),
    "frame": ("""
        SELECT q.*,
          coalesce(nullif(u.average_stars, 0), (SELECT avg(stars) FROM items)) AS user_avg_stars,
          coalesce(nullif(i.stars, 0), (SELECT avg(stars) FROM items)) AS item_avg_stars,
          coalesce(v.date_var, (SELECT avg(date_var) FROM date_var)) AS user_date_var,
          coalesce(u.review_count, (SELECT avg(review_count) FROM users)) AS user_review_count,
          coalesce(i.review_count, (SELECT avg(review_count) FROM items)) AS item_review_count,
          coalesce(u.fans, 0) AS fans,
          coalesce(ie.item_events, (SELECT avg(item_events) FROM item_events)) AS item_raters,
          coalesce(v.user_events, (SELECT avg(user_events) FROM date_var)) AS user_ratings,
          coalesce(i.latitude, 0) AS latitude, coalesce(i.longitude, 0) AS longitude,
          CASE WHEN i.good_for_groups = 'True' THEN 1 ELSE 0 END AS good_for_groups,
          coalesce(CAST(replace(u.member_since, '-', '') AS INTEGER),
                   (SELECT max(CAST(replace(member_since, '-', '') AS INTEGER)) + 1 FROM users)) AS member_since,
          CASE WHEN i.wifi = 'no' THEN 1 ELSE 0 END AS wifi_no,
          CASE WHEN i.item_id IS NOT NULL AND i.wifi IS NULL THEN 1 ELSE 0 END AS wifi_na,
          coalesce(CAST(i.price_range AS INTEGER), 0) AS price_range,
          CASE WHEN i.good_for_kids = 'True' THEN 1 ELSE 0 END AS good_for_kids,
          coalesce(s.checkin_slots, 0) AS checkin_slots,
          coalesce(u.funny, 0) AS funny,
          coalesce(u.useful, (SELECT avg(useful) FROM users)) AS useful,
          coalesce(u.cool, (SELECT avg(cool) FROM users)) AS cool,
          coalesce(u.compliment_hot, 0) AS compliment_hot, coalesce(u.compliment_note, 0) AS compliment_note,
          coalesce(fc.friend_count, (SELECT avg(friend_count) FROM friend_counts)) AS friend_count,
          CASE lk.code WHEN 'F' THEN 1 WHEN 'M' THEN 0 END AS lookup_code,
          coalesce(oc.days_open, (SELECT avg(days_open) FROM open_close)) AS days_open,
          coalesce(nullif(oc.opening_time, 0),
                   (SELECT sum(opening_time) FROM open_close) / (SELECT count(*) FROM items)) AS opening_time,
          coalesce(nullif(cm.closing_time, 0), (SELECT closing_mode FROM close_global)) AS closing_time,
          coalesce(fr.mean_stars, fp.friend_mean) AS friend_item_mean
        FROM frame_rows q
        LEFT JOIN users u ON u.user_id = q.user_id LEFT JOIN items i ON i.item_id = q.item_id
        LEFT JOIN date_var v ON v.user_id = q.user_id LEFT JOIN item_events ie ON ie.item_id = q.item_id
        LEFT JOIN slots s ON s.item_id = q.item_id LEFT JOIN friend_counts fc ON fc.user_id = q.user_id
        LEFT JOIN lookup lk ON lk.lookup_key = lower(u.name)
        LEFT JOIN open_close oc ON oc.item_id = q.item_id LEFT JOIN close_mode cm ON cm.item_id = q.item_id
        LEFT JOIN friend_rated fr ON fr.user_id = q.user_id AND fr.item_id = q.item_id
        LEFT JOIN friend_profile fp ON fp.user_id = q.user_id""",
        ("frame_rows", "users", "items", "date_var", "item_events", "slots", "friend_counts", "lookup",
         "open_close", "close_mode", "close_global", "friend_rated", "friend_profile")),
}

_TRAINING = {
    "wanted": ("SELECT DISTINCT user_id, item_id FROM events_all", ("events_all",)),
    "frame_rows": ("SELECT user_id, item_id, stars AS label FROM events_all", ("events_all",)),
}
_REQUESTED = {"frame_rows": ("SELECT user_id, item_id FROM pairs", ("pairs",))}
_VALIDATING = {
    "events_all": ("SELECT * FROM bag WHERE period = 'train'", ("bag",)),
    "requests": ("SELECT user_id, item_id FROM bag WHERE period = 'val'", ("bag",)),
}


def _query(select: str, *needs: str, dense: bool = False, **override: tuple[str, tuple[str, ...]]) -> str:
    """The SELECT with the parts it needs in front, each once and after its own needs."""
    parts = {**_PARTS, **override}
    if dense:
        parts["bag"] = (_bag(dense=True), ())
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in parts[name][1]:
                add(need)
            ordered.append(name)

    for name in needs:
        add(name)
    heads = ",\n".join(f"{name} AS ({parts[name][0]})" for name in ordered)
    return f"WITH {heads}\n{select}" if heads else select


def _frame_columns(label: bool) -> str:
    exact = {"user_date_var": 2}
    plain = [
        "user_avg_stars", "item_avg_stars", "user_date_var", "user_review_count", "item_review_count", "fans",
        "item_raters", "user_ratings", "latitude", "longitude", "good_for_groups", "member_since", "wifi_no",
        "wifi_na", "price_range", "good_for_kids", "checkin_slots", "funny", "useful", "cool", "compliment_hot",
        "compliment_note", "friend_count", "lookup_code", "days_open", "opening_time", "closing_time",
        "friend_item_mean",
    ]
    cols = [f"round(CAST({c} AS DOUBLE), {exact.get(c, 6)}) AS {c}" for c in plain]
    cols += [
        "round(CAST(user_avg_stars * item_avg_stars AS DOUBLE), 6) AS stars_product",
        "round(CAST(funny + useful + cool AS DOUBLE), 6) AS votes_sum",
    ]
    return ", ".join(["user_id", "item_id"] + (["label"] if label else []) + cols)


def _topk_sql(best: str) -> str:
    return _query(
        f"SELECT user_id, item_id, neighbor_id, round(w, 6) AS w, count(*) AS copies FROM {best} "
        "GROUP BY user_id, item_id, neighbor_id, w", best)


_CF = "SELECT user_id, item_id, cf_case, round(cf, 6) AS cf, trusted FROM cf"
_STAND_IN = """
    SELECT c.user_id, c.item_id, cf, trusted,
           0.5 * coalesce(um, m) + 0.5 * coalesce(im, m) AS model_score
    FROM cf c CROSS JOIN mu LEFT JOIN user_stats u ON u.user_id = c.user_id
    LEFT JOIN item_stats i ON i.item_id = c.item_id"""
_BLENDED = """
    SELECT p.user_id, p.item_id, CASE WHEN un IS NULL AND cnt IS NULL THEN m WHEN cnt IS NULL THEN um
           WHEN un IS NULL THEN im ELSE (im * cnt + um * un) / (cnt + un) END AS prediction
    FROM classed p CROSS JOIN mu"""


def oracle_sql() -> dict[str, str]:
    q = _query
    return {
        # Sources and sinks
        "scan_ratings": q(
            "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, stars FROM train", "train"),
        "scan_bad_ratings": q("""
            SELECT reason, count(*) AS n, CAST(sum(thousandths) AS BIGINT) AS thousandths FROM (
                SELECT CASE item_id % 50 WHEN 3 THEN 'broken' WHEN 4 THEN 'no stars' ELSE 'read' END AS reason,
                       CASE WHEN item_id % 50 NOT IN (3, 4) THEN CAST(stars * 1000 AS BIGINT) END AS thousandths FROM train
            ) GROUP BY reason""", "train"),
        "scan_users_last": q("""
            SELECT CAST(user_id AS VARCHAR) AS user_id, round(average_stars, 6) AS average_stars,
                   CAST(review_count + 1000 * (user_id % 3) AS BIGINT) AS review_count FROM users""", "users"),
        "scan_requests": q(
            "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, count(*) AS copies "
            "FROM requests GROUP BY 1, 2", "requests"),
        "scan_json_items": q("""
            SELECT CAST(i.item_id AS VARCHAR) AS item_id, stars, CAST(review_count AS BIGINT) AS review_count,
                   CAST(is_open AS BIGINT) AS is_open, round(latitude, 6) AS latitude, longitude,
                   good_for_kids, good_for_groups, wifi, price_range, CAST(coalesce(h.n, 0) AS BIGINT) AS n_days,
                   h.monday
            FROM items i LEFT JOIN (SELECT item_id, count(*) AS n,
                max(CASE WHEN day = 1 THEN opens_at || '-' || closes_at END) AS monday FROM hours GROUP BY item_id) h
            ON h.item_id = i.item_id""", "items", "hours"),
        "scan_lookup_map": q("""
            SELECT lookup_key, code, count(u.user_id) AS n_users FROM lookup
            LEFT JOIN users u ON lower(u.name) = lookup_key GROUP BY lookup_key, code""", "lookup", "users"),
        "sink_predictions_csv": q(
            "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, "
            f"round(prediction, 6) AS prediction FROM ({_BLENDED})", "classed", "mu"),
        # Projections, filters, scalar functions
        "filter_present_map": q("SELECT DISTINCT item_id FROM hours", "hours"),
        "row_range_slice": q("""
            SELECT user_id, rn - 1 AS row_no FROM (
                SELECT user_id, row_number() OVER (ORDER BY user_id) AS rn FROM (SELECT DISTINCT user_id FROM bag))
            WHERE rn - 1 >= 100 AND rn - 1 < 1000""", "bag"),
        "friend_edges": q("SELECT user_id, friend_id FROM edges", "edges"),
        "feat_friend_count": q("SELECT user_id, CAST(friend_count AS BIGINT) AS friend_count FROM friend_counts", "friend_counts"),
        "feat_days_open": q("SELECT item_id, days_open FROM open_close", "open_close"),
        "feat_checkin_slots": q(
            "SELECT i.item_id, coalesce(checkin_slots, 0) AS checkin_slots FROM items i LEFT JOIN slots s ON s.item_id = i.item_id",
            "items", "slots"),
        "feat_binary_attr": q(
            "SELECT item_id, CASE WHEN good_for_kids = 'True' THEN 1 ELSE 0 END AS good_for_kids, "
            "CASE WHEN good_for_groups = 'True' THEN 1 ELSE 0 END AS good_for_groups FROM items", "items"),
        "feat_onehot_attr": q("""
            SELECT p.user_id, p.item_id, CASE WHEN wifi = 'no' THEN 1 ELSE 0 END AS wifi_no,
                   CASE WHEN i.item_id IS NOT NULL AND wifi IS NULL THEN 1 ELSE 0 END AS wifi_na,
                   CASE WHEN wifi = 'free' THEN 1 ELSE 0 END AS wifi_free
            FROM pairs p LEFT JOIN items i ON i.item_id = p.item_id""", "pairs", "items"),
        "feat_price_range": q("SELECT item_id, coalesce(CAST(price_range AS INTEGER), 0) AS price_range FROM items", "items"),
        "feat_member_since": q("""
            SELECT p.user_id, p.item_id, coalesce(CAST(replace(u.member_since, '-', '') AS INTEGER),
                   (SELECT max(CAST(replace(member_since, '-', '') AS INTEGER)) + 1 FROM users)) AS member_since
            FROM pairs p LEFT JOIN users u ON u.user_id = p.user_id""", "pairs", "users"),
        "feat_hours_parse": q(
            "SELECT item_id, day, CAST(replace(opens_at, ':', '.') AS DOUBLE) AS opens, "
            "CAST(replace(closes_at, ':', '.') AS DOUBLE) AS closes FROM hours", "hours"),
        "dict_encode": q("""
            SELECT u.user_id, CASE l.code WHEN 'F' THEN 1.0::DOUBLE WHEN 'M' THEN 0.0::DOUBLE END AS lookup_code
            FROM users u LEFT JOIN lookup l ON l.lookup_key = lower(u.name)""", "users", "lookup"),
        "feat_interactions": q(
            "SELECT user_id, item_id, round(user_avg_stars * item_avg_stars, 6) AS stars_product, "
            "round(CAST(funny + useful + cool AS DOUBLE), 6) AS votes_sum FROM frame", "frame", **_REQUESTED),
        "linear_interp": q(
            "SELECT user_id, item_id, ord1, ord2, 6 - stars AS mirrored, round(0 + (stars - 1) * (100 - 0) / (5 - 1), 6) AS percent "
            "FROM events_all", "events_all"),
        "clip_range": q(
            "SELECT user_id, item_id, round(least(5.0, greatest(1.0, um + (im - um) * 4)), 6) AS clipped "
            "FROM classed WHERE cold_class = 'known'", "classed"),
        "impute_constant": q("""
            SELECT p.user_id, p.item_id, coalesce(u.fans, 0)::DOUBLE AS fans, coalesce(u.funny, 0)::DOUBLE AS funny,
                   coalesce(u.compliment_hot, 0)::DOUBLE AS compliment_hot, coalesce(u.compliment_note, 0)::DOUBLE AS compliment_note,
                   coalesce(i.is_open, 0)::DOUBLE AS is_open, round(coalesce(i.latitude, 0), 6) AS latitude,
                   coalesce(i.longitude, 0)::DOUBLE AS longitude
            FROM pairs p LEFT JOIN users u ON u.user_id = p.user_id LEFT JOIN items i ON i.item_id = p.item_id""",
            "pairs", "users", "items"),
        "cold_start_class": q("SELECT user_id, item_id, cold_class FROM classed", "classed"),
        # Joins
        "feat_user_join": q("""
            SELECT p.user_id, p.item_id, round(u.average_stars, 6) AS average_stars, u.review_count AS user_review_count,
                   v.user_events, round(v.date_var, 2) AS date_var
            FROM pairs p LEFT JOIN users u ON u.user_id = p.user_id LEFT JOIN date_var v ON v.user_id = p.user_id""",
            "pairs", "users", "date_var"),
        "feat_item_join": q("""
            SELECT p.user_id, p.item_id, i.stars AS item_stars, CAST(i.review_count AS BIGINT) AS item_review_count,
                   e.item_events, s.checkin_slots, o.days_open
            FROM pairs p LEFT JOIN items i ON i.item_id = p.item_id LEFT JOIN item_events e ON e.item_id = p.item_id
            LEFT JOIN slots s ON s.item_id = p.item_id LEFT JOIN open_close o ON o.item_id = p.item_id""",
            "pairs", "items", "item_events", "slots", "open_close"),
        "cf_candidates": q(
            "SELECT user_id, item_id, neighbor_id, neighbor_stars, count(*) AS copies FROM cand "
            "GROUP BY user_id, item_id, neighbor_id, neighbor_stars", "cand"),
        "co_rating_counts": q(
            "SELECT DISTINCT item_id, neighbor_id, co_raters FROM weights", "weights"),
        "friend_item_mean": q(
            "SELECT user_id, item_id, round(mean_stars, 6) AS friend_item_mean, n AS n_friend_ratings FROM friend_rated",
            "friend_rated"),
        "friend_mean_fallback": q("""
            SELECT p.user_id, round(friend_mean, 6) AS friend_mean FROM (SELECT DISTINCT user_id FROM pairs) p
            JOIN friend_profile f ON f.user_id = p.user_id""", "pairs", "friend_profile"),
        # Aggregations
        "dedupe_last": q("SELECT user_id, item_id, stars FROM last_rating", "last_rating"),
        "global_mean": q("SELECT round(m, 6) AS global_mean, (SELECT count(*) FROM last_rating) AS n FROM mu", "mu"),
        "group_to_list": q("""
            SELECT 'user' AS side, user_id AS id, item_id AS member, count(*) AS copies FROM events_all GROUP BY user_id, item_id
            UNION ALL SELECT 'item', item_id, user_id, count(*) FROM events_all GROUP BY user_id, item_id""", "events_all"),
        "entity_means": q("""
            SELECT 'user' AS side, user_id AS id, un AS events, round(um, 6) AS mean_stars FROM user_stats
            UNION ALL SELECT 'item', item_id, cnt, round(im, 6) FROM item_stats""", "user_stats", "item_stats"),
        "feat_activity_counts": q("""
            SELECT 'user' AS side, user_id AS id, count(*) AS n_events FROM train GROUP BY user_id
            UNION ALL SELECT 'item', item_id, count(*) FROM train GROUP BY item_id""", "train"),
        "feat_date_variance": q("SELECT user_id, round(date_var, 2) AS date_var FROM date_var", "date_var"),
        "feat_open_time": q("SELECT item_id, round(opening_time, 6) AS opening_time FROM open_close", "open_close"),
        "feat_close_mode": q("SELECT item_id, closing_time FROM close_mode", "close_mode"),
        "global_mode": q("SELECT closing_mode FROM close_global", "close_global"),
        "pcc_pairs": q(
            f"SELECT DISTINCT item_id, neighbor_id, co_raters, round({_PEARSON}, 6) AS pearson "
            "FROM ruled WHERE n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0", "ruled"),
        "similarity_ladder": q(
            "SELECT DISTINCT item_id, neighbor_id, co_raters, rule, round(w, 6) AS w FROM weights", "weights"),
        "topk_neighbors": _topk_sql("best"),
        "topk_neighbors_signed": _topk_sql("best_signed"),
        "topk_neighbors_abs": _topk_sql("best_abs"),
        "topk_neighbors_heavy": _topk_sql("best"),
        "cf_predict_heavy": q(_CF, "cf"),
        "cf_confidence": q(
            "SELECT user_id, item_id, n_computed, n_computed >= 2 AS trusted FROM trust", "trust"),
        "cf_predict": q(_CF, "cf"),
        "cf_predict_dense": q(_CF, "cf", dense=True),
        "blend_means": q(f"SELECT user_id, item_id, round(prediction, 6) AS prediction FROM ({_BLENDED})", "classed", "mu"),
        "impute_mean": q("""
            SELECT p.user_id, p.item_id, round(coalesce(u.useful, (SELECT avg(useful) FROM users)), 6) AS useful,
                   round(coalesce(u.cool, (SELECT avg(cool) FROM users)), 6) AS cool,
                   round(coalesce(nullif(u.average_stars, 0), (SELECT avg(stars) FROM items)), 6) AS user_avg_stars,
                   round(coalesce(nullif(i.stars, 0), (SELECT avg(stars) FROM items)), 6) AS item_avg_stars,
                   round(coalesce(fc.friend_count, (SELECT avg(friend_count) FROM friend_counts)), 6) AS friend_count
            FROM pairs p LEFT JOIN users u ON u.user_id = p.user_id LEFT JOIN items i ON i.item_id = p.item_id
            LEFT JOIN friend_counts fc ON fc.user_id = p.user_id""", "pairs", "users", "items", "friend_counts"),
        "impute_opening": q("""
            SELECT p.item_id, round(coalesce(nullif(o.opening_time, 0),
                   (SELECT sum(opening_time) FROM open_close) / (SELECT count(*) FROM items)), 6) AS opening_time
            FROM (SELECT DISTINCT item_id FROM pairs) p LEFT JOIN open_close o ON o.item_id = p.item_id""",
            "pairs", "open_close", "items"),
        "eval_rmse": q("""
            SELECT count(*) AS n, round(sqrt(avg((v.stars - c.cf) * (v.stars - c.cf))), 6) AS rmse
            FROM cf c JOIN val v ON v.user_id = c.user_id AND v.item_id = c.item_id""", "cf", "val", **_VALIDATING),
        "eval_error_hist": q("""
            SELECT b.bucket, count(e.bucket) AS n FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS bucket) b
            LEFT JOIN (SELECT CAST(least(4, floor(round(abs(v.stars - c.cf), 9))) AS INTEGER) AS bucket
                       FROM cf c JOIN val v ON v.user_id = c.user_id AND v.item_id = c.item_id) e
            ON e.bucket = b.bucket GROUP BY b.bucket""", "cf", "val", **_VALIDATING),
        # Unions, frames, blends
        "union_ratings": q("SELECT user_id, item_id, stars, rated_on FROM events_all", "events_all"),
        "feature_frame": q(f"SELECT {_frame_columns(False)} FROM frame", "frame", **_REQUESTED),
        "training_frame": q(f"SELECT {_frame_columns(True)} FROM frame", "frame", **_TRAINING),
        "model_roundtrip": q("SELECT user_id, item_id, TRUE AS same FROM pairs", "pairs"),
        "gbt_walk": q("SELECT user_id, item_id, TRUE AS same FROM pairs", "pairs"),
        "gbt_error_curve": q(
            "SELECT CAST(t AS BIGINT) AS trees, n, TRUE AS falls FROM (SELECT unnest([0, 5, 10]) AS t), (SELECT count(*) AS n FROM val)", "val"),
        "tune_gbt": "SELECT depth, learning_rate, trees, TRUE AS possible FROM (VALUES (2), (4)) d(depth), "
                    "(VALUES (0.05::DOUBLE), (0.2::DOUBLE)) r(learning_rate), (VALUES (1), (3)) t(trees)",
        "hybrid_model_eval": q("SELECT count(*) AS n, TRUE AS beats_base FROM val", "val"),
        "ensemble_mean": q(f"SELECT user_id, item_id, round(model_score, 6) AS model_score FROM ({_STAND_IN})",
                           "cf", "mu", "user_stats", "item_stats"),
        "hybrid_blend": q(f"""
            SELECT user_id, item_id, round(least(5.0, greatest(1.0,
                   CASE WHEN trusted THEN 0.2 * cf + 0.8 * model_score ELSE 0.1 * cf + 0.9 * model_score END)), 6) AS prediction
            FROM ({_STAND_IN})""", "cf", "mu", "user_stats", "item_stats"),
        "hybrid_eval": q(f"""
            SELECT count(*) AS n, round(sqrt(avg((v.stars - p.prediction) * (v.stars - p.prediction))), 6) AS rmse
            FROM (SELECT user_id, item_id, least(5.0, greatest(1.0, CASE WHEN trusted THEN 0.2 * cf + 0.8 * model_score
                         ELSE 0.1 * cf + 0.9 * model_score END)) AS prediction FROM ({_STAND_IN})) p
            JOIN val v ON v.user_id = p.user_id AND v.item_id = p.item_id""",
            "cf", "mu", "user_stats", "item_stats", "val", **_VALIDATING),
    }
