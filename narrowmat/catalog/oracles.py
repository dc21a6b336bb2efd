"""SQL for DuckDB that gives the answers of ``queries``."""

from __future__ import annotations

LINEITEM = ["1.0::double", "l_quantity", "l_extendedprice / 1000", "l_discount * 100"]
TWO = ["l_quantity", "l_extendedprice / 1000"]


def gram_cte(columns: list[str], source: str) -> str:
    """One row ``g`` with ``gi_j`` for i <= j."""
    n = len(columns)
    named = ", ".join(f"{c} AS c{i}" for i, c in enumerate(columns))
    sums = ", ".join(
        f"sum(c{i} * c{j}) AS g{i}_{j}" for i in range(n) for j in range(i, n)
    )
    return f"m AS (SELECT {named} FROM {source}), g AS (SELECT {sums} FROM m)"


def cholesky_cte(n: int) -> str:
    """From ``g``, one row ``r`` with ``ri_j``: a diagonal entry and the rest of
    its row in turn."""
    steps, last = [], "g"
    for k in range(n):
        taken = "".join(f" - r{i}_{k} * r{i}_{k}" for i in range(k))
        steps.append(f"d{k} AS (SELECT *, sqrt(g{k}_{k}{taken}) AS r{k}_{k} FROM {last})")
        last = f"d{k}"
        rest = ", ".join(
            f"(g{k}_{j}"
            + "".join(f" - r{i}_{k} * r{i}_{j}" for i in range(k))
            + f") / r{k}_{k} AS r{k}_{j}"
            for j in range(k + 1, n)
        )
        if rest:
            steps.append(f"e{k} AS (SELECT *, {rest} FROM {last})")
            last = f"e{k}"
    return ", ".join(steps) + f", r AS (SELECT * FROM {last})"


def solve_cte(n: int) -> str:
    """From ``r`` of ``[A | b]``, one row ``x`` with the coefficients ``xj``."""
    steps, last = [], "r"
    for k in reversed(range(n)):
        known = "".join(f" - r{k}_{j} * x{j}" for j in range(k + 1, n))
        steps.append(f"s{k} AS (SELECT *, (r{k}_{n}{known}) / r{k}_{k} AS x{k} FROM {last})")
        last = f"s{k}"
    return ", ".join(steps) + f", x AS (SELECT * FROM {last})"


def entries(name: str, n: int, digits: int, of: str, symmetric: bool = False) -> str:
    """A one-row matrix as ``i, j, value``."""
    rows = []
    for i in range(n):
        for j in range(n):
            value = f"{of}{i}_{j}" if i <= j else (f"{of}{j}_{i}" if symmetric else "0.0")
            rows.append(
                f"SELECT {i} AS i, {j} AS j, round({value}, {digits}) + 0.0 AS value FROM {name}"
            )
    return " UNION ALL ".join(rows)


def r_sql(columns: list[str], source: str, digits: int = 4) -> str:
    n = len(columns)
    head = f"WITH {gram_cte(columns, source)}, {cholesky_cte(n)}"
    return f"{head} {entries('r', n, digits, 'r')}"


def gram_sql(columns: list[str], source: str, digits: int, factor: str = "") -> str:
    n = len(columns)
    cte = gram_cte([f"({c})" for c in columns], source)
    if factor:
        cte = cte.replace("sum(", f"{factor} * sum(")
    return f"WITH {cte} {entries('g', n, digits, 'g', symmetric=True)}"


def list_gram_sql(rows: str, n: int, digits: int = 6) -> str:
    """Gram matrix of a list column ``e`` (from 1) of the query ``rows``."""
    return f"""
        WITH m AS ({rows}),
             a AS (SELECT i::integer AS i FROM range(0, {n}) t(i)),
             b AS (SELECT j::integer AS j FROM range(0, {n}) t(j))
        SELECT i, j, round(sum(e[i + 1]::double * e[j + 1]::double), {digits}) + 0.0 AS value
        FROM m, a, b GROUP BY i, j"""


def solve_sql(columns: list[str], source: str, digits: int) -> str:
    n = len(columns) - 1
    head = f"WITH {gram_cte(columns, source)}, {cholesky_cte(n + 1)}, {solve_cte(n)} "
    return head + " UNION ALL ".join(
        f"SELECT {j} AS j, round(x{j}, {digits}) + 0.0 AS x FROM x" for j in range(n)
    )


def list_solve_sql(rows: str, n: int, digits: int) -> str:
    """Least squares of the last entry of a list column ``e`` on its first ``n``, by
    Gauss-Jordan elimination on the Gram matrix, and the norm of the residual."""
    return f"""
        WITH RECURSIVE m AS ({rows}),
             a AS (SELECT i::integer AS i FROM range(0, {n + 1}) t(i)),
             b AS (SELECT j::integer AS j FROM range(0, {n + 1}) t(j)),
             g AS (SELECT i, j, sum(e[i + 1]::double * e[j + 1]::double) AS v FROM m, a, b GROUP BY i, j),
             s AS (SELECT 0 AS k, i, j, v FROM g
                   UNION ALL
                   SELECT s.k + 1, s.i, s.j,
                          CASE WHEN s.i = s.k THEN s.v / p.v ELSE s.v - c.v * r.v / p.v END
                   FROM s JOIN s p ON p.i = s.k AND p.j = s.k
                        JOIN s r ON r.i = s.k AND r.j = s.j
                        JOIN s c ON c.i = s.i AND c.j = s.k
                   WHERE s.k < {n})
        SELECT x.i AS j, round(x.v, {digits}) + 0.0 AS x, round(sqrt(q.v), {digits}) + 0.0 AS residual
        FROM s x, s q WHERE x.k = {n} AND x.j = {n} AND x.i < {n} AND q.k = {n} AND q.i = {n} AND q.j = {n}"""


def pair_sql(columns: list[str]) -> str:
    """Singular values and vectors of two columns, from the 2 x 2 Gram matrix."""
    return f"""
    WITH {gram_cte(columns, 'lineitem')},
    t AS (SELECT g0_0 AS p, g0_1 AS q, g1_1 AS r,
                 sqrt((g0_0 - g1_1) * (g0_0 - g1_1) + 4 * g0_1 * g0_1) AS gap FROM g),
    l AS (SELECT *, (p + r + gap) / 2 AS l0,
                 (p * r - q * q) / ((p + r + gap) / 2) AS l1 FROM t),
    w AS (SELECT 0 AS k, sqrt(l0) AS s, q AS a, l0 - p AS b FROM l
          UNION ALL SELECT 1, sqrt(l1), q, l1 - p FROM l),
    v AS (SELECT k, s, abs(a) / sqrt(a * a + b * b) AS v0,
                 CASE WHEN a < 0 THEN -b ELSE b END / sqrt(a * a + b * b) AS v1 FROM w)
"""


PAIR = pair_sql(TWO)


def share_sql(term: str) -> str:
    return f"""{PAIR} SELECT k, round(s, 5) + 0.0 AS s,
        round(sum({term}) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)
              / sum({term}) OVER (), 9) + 0.0 AS share FROM v"""


def vectors_sql(where: str = "") -> str:
    return f"""{PAIR} SELECT k, 0 AS j, round(v0, 8) + 0.0 AS v FROM v {where}
        UNION ALL SELECT k, 1, round(v1, 8) + 0.0 FROM v {where}"""


LEVERAGE = """
    WITH g AS (SELECT sum(value * value) AS p, sum(value * user_id) AS q,
                      sum(user_id::double * user_id) AS r FROM events)
    SELECT event_id,
           round((r * value * value - 2 * q * value * user_id + p * user_id * user_id)
                 / (p * r - q * q), 10) + 0.0 AS leverage
    FROM events, g"""

LEVEL = "floor(abs(embedding[{p} % 64 + 1]::double * 1000))::bigint"


def byte(p: str, spread: bool) -> str:
    level = LEVEL.format(p=p)
    return f"(({level} + {p} * 13 + vec_id * 7) % 256)" if spread else f"({level} % 256)"


def pixel(p: int | str, side: int, spread: bool) -> str:
    size = side * side
    red, green, blue = (byte(f"({p} + {c * size})", spread) for c in range(3))
    return (
        f"(0.299::double * {red} + 0.587::double * {green} + 0.114::double * {blue})"
        " / 255.0::double"
    )


def rows_sql(table: str, key: str, row: str, n: int, digits: int) -> str:
    """A list column in long form."""
    return f"""
        WITH m AS (SELECT {key} AS key, {row} AS e FROM {table}),
             a AS (SELECT j::integer AS j FROM range(0, {n}) t(j))
        SELECT key AS {key}, j, round(e[j + 1]::double, {digits}) + 0.0 AS value FROM m, a"""


CENTRED = """SELECT list_transform(embedding, lambda x: x::double
    - list_sum(list_transform(embedding, lambda y: y::double)) / 64) AS e FROM embeddings"""

CENTRED_ROW = """list_transform(embedding, lambda x: x::double
    - list_sum(list_transform(embedding, lambda y: y::double)) / 64)"""

WORDS = """
    SELECT word, count(*) AS count
    FROM (SELECT unnest(string_split(
              CASE WHEN suffix(text, ' ') THEN left(text, length(text) - 1) ELSE text END,
              ' ')) AS word
          FROM {table} WHERE text <> '')
    GROUP BY word"""

RAGGED = """(SELECT CASE WHEN l_linenumber <= 3 THEN 2 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END
    AS n FROM lineitem)"""

FEATURES = ["l_quantity", "l_quantity * l_quantity / 100"]

GRAY25 = ", ".join(pixel(p, 5, False) for p in range(25))
RED25 = " + ".join(f"{byte(str(p), False)}::double" for p in range(25))

OTHER = ["l_quantity", "l_tax * 100", "l_extendedprice / 500", "2.0::double"]


def with_ones_sql(columns: list[str], source: str) -> str:
    """R of the columns below a matrix with the R of ones, whose Gram is min(i, j) + 1."""
    n = len(columns)
    more = ", ".join(f"g{i}_{j} + {i + 1} AS g{i}_{j}" for i in range(n) for j in range(i, n))
    gram = gram_cte(columns, source).replace("g AS (", "h AS (")
    return f"WITH {gram}, g AS (SELECT {more} FROM h), {cholesky_cte(n)} {entries('r', n, 4, 'r')}"


def wrong_ones_sql(columns: list[str], source: str, tol: float) -> str:
    n = len(columns)
    wrong = " + ".join(
        f"(abs(r{i}_{j} - 1) > {tol})::bigint" for i in range(n) for j in range(i, n)
    )
    return f"""WITH {gram_cte(columns, source)}, {cholesky_cte(n)}
        SELECT CASE WHEN {wrong} = 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict,
               {wrong} AS nerrs, 'own' AS matrix FROM r
        UNION ALL SELECT 'CORRECT', 0::bigint, 'turned'"""


def line_fit(y: str) -> str:
    return f"regr_intercept({y}, l_quantity) AS {{0}}0, regr_slope({y}, l_quantity) AS {{0}}1"


def oracles() -> dict[str, str]:
    r_lineitem = r_sql(LINEITEM, "lineitem")
    embedding_gram = list_gram_sql("SELECT embedding AS e FROM embeddings", 64)
    centred_gram = list_gram_sql(CENTRED, 64)
    gray_rows = f"SELECT [{GRAY25}] AS p FROM embeddings"
    return {
        "tsqr_lineitem": r_lineitem,
        "tsqr_scheduled": r_lineitem,
        "tsqr_block_rows": r_lineitem,
        "tsqr_embeddings": embedding_gram,
        "tsqr_rows": "SELECT 0 AS stage, count(*) AS rows FROM lineitem",
        "tsqr_random_keys": f"SELECT *, true AS fits FROM ({r_lineitem})",
        "tsqr_first_keys": f"SELECT (SELECT min(l_orderkey) FROM lineitem) AS first, * FROM ({r_lineitem})",
        "gram_lineitem": gram_sql(LINEITEM, "lineitem", 3),
        "gram_union": gram_sql(
            ["a", "b"],
            "(SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem UNION ALL "
            "SELECT o_custkey / 1000, o_totalprice / 1000 FROM orders)", 3
        ),
        "gram_scheduled": gram_sql(LINEITEM, "lineitem", 3),
        "gram_embeddings": embedding_gram,
        "cholesky_qr": r_lineitem,
        "user_kernel": f"WITH {gram_cte(LINEITEM, 'lineitem')} "
        + " UNION ALL ".join(
            f"SELECT 0 AS i, {j} AS j, round(max(c{j}), 6) + 0.0 AS value FROM m"
            for j in range(4)
        ),
        "user_features": r_sql(FEATURES, "lineitem"),
        "svd_values": f"{PAIR} SELECT k, round(s, 5) + 0.0 AS s FROM v",
        "svd_right_vectors": vectors_sql(),
        "top_components": vectors_sql("WHERE k < 1"),
        "variance_share": share_sql("s"),
        "variance_share_squared": share_sql("s * s"),
        "numerical_rank": """
            SELECT CASE WHEN sum(l_quantity * l_quantity) * sum(l_tax * l_tax)
                        > sum(l_quantity * l_tax) * sum(l_quantity * l_tax) * (1 + 1e-9)
                   THEN 2 ELSE 1 END AS rank FROM lineitem""",
        "dependent_columns": f"""
            WITH own AS (SELECT unnest([0, 1, 4]) AS j)
            SELECT j, j AS k, 1.0::double AS coefficient FROM own WHERE (SELECT max(abs(l_tax)) FROM lineitem) > 0
            UNION ALL SELECT 2, j, x FROM ({solve_sql(["l_quantity", "l_tax", "3 * l_quantity - 2 * l_tax"], "lineitem", 8)})
            UNION ALL SELECT 5, [0, 4][j + 1], x FROM ({solve_sql(["l_quantity", "l_extendedprice / 1000", "l_extendedprice / 500 + l_quantity"], "lineitem", 8)})""",
        "svd_left_gram": """
            SELECT i::integer AS i, j::integer AS j, CASE WHEN i = j AND i < r THEN 1.0 ELSE 0.0 END::double AS value
            FROM range(0, 3) a(i), range(0, 3) b(j),
                 (SELECT 1 + (count(DISTINCT l_tax / l_quantity) > 1)::integer AS r FROM lineitem)""",
        "direct_qr_gram": """
            SELECT i::integer AS i, j::integer AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::double AS value
            FROM range(0, 3) a(i), range(0, 3) b(j) WHERE (SELECT count(*) FROM lineitem) >= 3""",
        "svd_left_leverage": LEVERAGE,
        "svd_left_refined": LEVERAGE,
        "svd_reconstruct": rows_sql("embeddings", "vec_id", "embedding", 64, 5),
        "project": rows_sql(
            "events",
            "event_id",
            "[value + 0.25::double * user_id, 0.5::double * value + 2.0::double * user_id, -value]",
            3,
            6,
        ),
        "project_blocked": rows_sql(
            "events",
            "event_id",
            "[value + 0.25::double * user_id, 0.5::double * value + 2.0::double * user_id, -value]",
            3,
            6,
        ),
        "least_squares": """
            WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a,
                              regr_slope(l_extendedprice, l_quantity) AS b,
                              sqrt(regr_syy(l_extendedprice, l_quantity)
                                   * (1 - regr_r2(l_extendedprice, l_quantity))) AS c
                       FROM lineitem)
            SELECT 'x0' AS term, round(a, 4) + 0.0 AS value FROM f
            UNION ALL SELECT 'x1', round(b, 4) + 0.0 FROM f
            UNION ALL SELECT 'residual', round(c, 4) + 0.0 FROM f""",
        "least_squares_wide": solve_sql(
            [
                "1.0::double", "l_quantity", "l_discount * 100", "l_partkey / 100.0::double",
                "l_extendedprice / 1000",
            ],
            "lineitem",
            8,
        ),
        "center_rows": rows_sql("embeddings", "vec_id", CENTRED_ROW, 64, 7),
        "pca_gram": centred_gram,
        "pca_rank": """
            SELECT CASE WHEN q > 0 THEN 1 ELSE 0 END AS rank, round(sqrt(q / 2), 5) + 0.0 AS s
            FROM (SELECT sum((l_quantity - l_extendedprice / 1000)
                             * (l_quantity - l_extendedprice / 1000)) AS q FROM lineitem)""",
        "least_squares_rows": "SELECT 0 AS stage, count(*) AS rows, count(*) > 0 AS compressed FROM lineitem",
        "col_sums": f"WITH {gram_cte(LINEITEM, 'lineitem')} "
        + " UNION ALL ".join(
            f"SELECT {j} AS j, round(sum(c{j}), 3) + 0.0 AS value FROM m" for j in range(4)
        ),
        "col_sums_embeddings": """
            SELECT (p - 1)::integer AS j, round(sum(v), 6) + 0.0 AS value
            FROM (SELECT unnest(embedding)::double AS v,
                         generate_subscripts(embedding, 1) AS p FROM embeddings)
            GROUP BY p""",
        "word_count": WORDS.format(table="documents"),
        "word_count_conversations": WORDS.format(table="conversations"),
        "duplicate_keys": """
            SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem
            GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "matrix_shape": """
            SELECT count(*) AS nrows, 4 AS ncols_min, 4 AS ncols_max,
                   false AS ragged, count(*) = 4 AS square FROM lineitem""",
        "matrix_shape_ragged": f"""
            SELECT count(*) AS nrows, min(n) AS ncols_min, max(n) AS ncols_max,
                   min(n) <> max(n) AS ragged,
                   count(*) = max(n) AND min(n) = max(n) AS square FROM {RAGGED}""",
        "row_widths": f"SELECT n AS width, count(*) AS nrows FROM {RAGGED} GROUP BY n",
        "replicate": gram_sql(LINEITEM, "lineitem", 3, factor="3"),
        "profile_values": """
            WITH p AS (SELECT json(props) AS v FROM events),
            k AS (SELECT unnest(json_keys(v)) AS name, v FROM p),
            f AS (SELECT '$.' || name AS path,
                         CASE json_type(v, '$.' || name)
                              WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
                              ELSE json_type(v, '$.' || name) END AS type,
                         NULL::integer AS n FROM k)
            SELECT path, type, count(*) AS count, min(n) AS min_len, max(n) AS max_len
            FROM (SELECT path, type, len(json_keys(v))::integer AS n
                  FROM (SELECT '$' AS path, 'object' AS type, v FROM p)
                  UNION ALL SELECT * FROM f)
            GROUP BY path, type""",
        "profile_nested": """
            SELECT path, type, count(*) * each AS count, min(n) AS min_len, max(n) AS max_len
            FROM part, (VALUES ('$', 'object', 4, 1), ('$.id', 'integer', NULL, 1),
                 ('$.name', 'string', -1, 1), ('$.dims', 'array', 2, 1),
                 ('$.dims[]', 'integer', NULL, 1), ('$.dims[]', 'string', 1, 1),
                 ('$.info', 'object', 2, 1), ('$.info.brand', 'string', -2, 1),
                 ('$.info.none', 'null', NULL, 1)) t(path, type, size, each),
                 LATERAL (SELECT CASE size WHEN -1 THEN length(p_name)
                                 WHEN -2 THEN length(p_brand) ELSE size END::integer AS n)
            GROUP BY path, type, each""",
        "profile_deep": f"""
            WITH deep AS (SELECT p_brand, len(p_brand)::integer AS n FROM part WHERE p_size > 5)
            SELECT '$' || repeat('.l', k::integer) AS path, 'object' AS type, count(*) AS count,
                   CASE WHEN k < 8 THEN 1 ELSE 2 END::integer AS min_len,
                   CASE WHEN k < 8 THEN 1 ELSE 2 END::integer AS max_len
            FROM deep, range(9) t(k) GROUP BY k
            UNION ALL SELECT '${".l" * 8}[''a.b'']', 'string', count(*), min(n), max(n) FROM deep HAVING count(*) > 0
            UNION ALL SELECT '${".l" * 8}.ab', 'integer', count(*), NULL, NULL FROM deep HAVING count(*) > 0
            UNION ALL SELECT '$', 'null', count(*), NULL, NULL FROM part
                      WHERE NOT coalesce(p_size > 5, false) HAVING count(*) > 0""",
        "text_rows": rows_sql(
            "part", "p_partkey", "[p_partkey::double, p_size::double, p_retailprice]", 3, 6
        ),
        "labelled_rows": """
            SELECT p_partkey, p_partkey::double AS rhs, p_size::double AS x0,
                   p_retailprice AS x1 FROM part""",
        "packed_rows": rows_sql("embeddings", "vec_id", "embedding", 64, 9),
        "drop_bad_rows": gram_sql(
            ["l_quantity", "l_tax"], "lineitem WHERE l_linenumber <= 3", 4
        ),
        "text_lines": """
            SELECT printf('%18.16e', o_totalprice) || ' ' || printf('%18.16e', o_totalprice / 7)
                   AS line FROM orders""",
        "text_roundtrip": """
            SELECT o_orderkey::double AS o_orderkey, o_custkey::double AS o_custkey,
                   o_totalprice, o_totalprice / 7 AS seventh FROM orders""",
        "labelled_roundtrip": """
            SELECT p_retailprice AS rhs, p_partkey::double AS p_partkey,
                   p_size::double AS p_size FROM part""",
        "factor_files": f"""SELECT * FROM ({centred_gram}),
            (VALUES ('R'), ('V, S')) t(source)""",
        "regression_files": f"""
            WITH {gram_cte(['1.0::double', *TWO], 'lineitem')}, {cholesky_cte(3)}, {solve_cte(2)}
            SELECT name, i, j, round(value, 6) + 0.0 AS value FROM x, LATERAL (VALUES
                ('R', 0, 0, r0_0), ('R', 0, 1, r0_1), ('R', 1, 0, 0.0::double), ('R', 1, 1, r1_1),
                ('y', 0, 0, r0_2), ('y', 1, 0, r1_2), ('sol', 0, 0, x0), ('sol', 1, 0, x1)
            ) t(name, i, j, value)""",
        "saved_factor": r_lineitem,
        "fixed_records": rows_sql("embeddings", "vec_id", "embedding", 64, 9),
        "fixed_records_hadoop": rows_sql("embeddings", "vec_id", "embedding", 64, 9),
        "fixed_records_pattern": rows_sql("embeddings", "vec_id", "embedding", 64, 9),
        "record_numbers": """
            SELECT count(*) AS nrows, count(*) AS aligned, count(*) AS numbered,
                   count(*) AS decoded, count(DISTINCT vec_id) AS keys FROM embeddings""",
        "peek": f"""
            SELECT vec_id AS key, 48 AS length,
                   array_to_string([printf('%02X', {byte('p', True)}) for p in range(10)], '') AS head
            FROM embeddings ORDER BY vec_id LIMIT 2""",
        "rgb_sums": f"""
            SELECT vec_id AS record,
                   list_sum([{byte('p', True)} for p in range(0, 1024)])::bigint AS r,
                   list_sum([{byte('p', True)} for p in range(1024, 2048)])::bigint AS g,
                   list_sum([{byte('p', True)} for p in range(2048, 3072)])::bigint AS b
            FROM embeddings""",
        "gray": f"""
            SELECT vec_id AS record, j, round({pixel('j', 8, True)}, 9) + 0.0 AS value
            FROM embeddings, (SELECT j::integer AS j FROM range(0, 64) t(j))""",
        "image_regression_rows": list_solve_sql(
            f"SELECT [{GRAY25}, {RED25}] AS e FROM embeddings", 25, 5
        ),
        "image_pca": list_gram_sql(
            f"SELECT list_transform(p, lambda x: x - list_sum(p) / 25) AS e FROM ({gray_rows})",
            25,
        ),
        "gen_matrix_r": with_ones_sql(LINEITEM, "lineitem"),
        "check_matrix": wrong_ones_sql(LINEITEM, "lineitem", 0.5),
        "mix_rows": r_sql(["value", "user_id::double"], "events"),
        "normalize_signs": r_lineitem,
        "compare_factors": f"""
            SELECT i AS "index", round(sum(abs(a.value - b.value)), 3) + 0.0 AS absdiff
            FROM ({r_sql(LINEITEM, 'lineitem', 9)}) a
            JOIN ({r_sql(OTHER, 'lineitem', 9)}) b USING (i, j) GROUP BY i""",
        "compare_vectors": f"""
            SELECT a.k AS "index",
                   round(abs(a.v0 - b.v0) + abs(a.v1 - b.v1), 8) + 0.0 AS absdiff
            FROM ({pair_sql(TWO)} SELECT * FROM v) a
            JOIN ({pair_sql(['l_quantity', 'l_tax * 100'])} SELECT * FROM v) b ON a.k = b.k""",
        "relative_difference": f"""
            WITH f AS (SELECT {line_fit('l_extendedprice').format('z')},
                              {line_fit('l_extendedprice * (1 - l_discount)').format('y')} FROM lineitem)
            SELECT round(sqrt((z0 - y0) * (z0 - y0) + (z1 - y1) * (z1 - y1))
                         / sqrt(z0 * z0 + z1 * z1), 9) + 0.0 AS reldiff FROM f""",
    }
