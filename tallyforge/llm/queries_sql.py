"""SQL of the license scan, the mixture, the spelling variants and the collocations, built from their parameters."""

from __future__ import annotations


def license_sql(templates: dict[str, str]) -> str:
    rows = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(templates.items()))
    shingles = r"""list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])"""
    words = r"string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
        WITH t(license_id, txt) AS (VALUES {rows}),
        ts AS (SELECT license_id, list_distinct({shingles}) AS s FROM (SELECT license_id, {words.format("txt")} AS w FROM t)),
        tg AS (SELECT license_id, len(s) AS n, unnest(s) AS g FROM ts),
        ds AS (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {words.format("text")} AS w FROM documents)),
        dg AS (SELECT doc_id, unnest(s) AS g, generate_subscripts(s, 1) - 1 AS pos FROM ds)
        SELECT doc_id, license_id, round(count(DISTINCT g)::DOUBLE / n, 6) AS containment, count(DISTINCT g)::INT AS matched,
               n::INT AS n_shingles, min(pos)::INT AS first_word
        FROM dg JOIN tg USING (g) GROUP BY doc_id, license_id, n HAVING count(DISTINCT g) >= ceil(n * 0.8)
    """


def _weight(columns: list[str], weights: dict[tuple[str, ...], int]) -> str:
    mine = [(k, w) for k, w in weights.items() if len(k) == len(columns)]
    return "CASE " + " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(columns, k)) + f" THEN {w}" for k, w in mine) + " ELSE 1 END" if mine else "1"


def mixing_sql(domain: str, weights: dict[tuple[str, ...], int], share: tuple[int, int], epochs: int, seed: int) -> str:
    """All weights must be positive here."""
    names, ctes, given = ["d", "l", "s"], [], None
    for depth, name in enumerate(names):
        path, parent = ", ".join(names[: depth + 1]), names[:depth]
        by = "PARTITION BY " + ", ".join([*parent, "budget"])
        source = f"(SELECT (sum(have) * {share[0]} // {share[1]})::BIGINT AS budget FROM leaves)" if given is None else given
        on = "CROSS JOIN" if given is None else "JOIN"
        using = "" if given is None else f"USING ({', '.join(parent)})"
        ctes.append(f"""
        n{depth} AS (SELECT {path}, sum(have * {epochs})::BIGINT AS cap, ({_weight(names[: depth + 1], weights)})::BIGINT AS w FROM leaves GROUP BY {path}),
        r{depth} AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lft,
                            (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS sw
                     FROM n{depth} {on} {source} q {using} WINDOW o AS ({by} ORDER BY cap / w, {name})),
        f{depth} AS (SELECT *, cap::DOUBLE * sw <= w::DOUBLE * lft AS whole FROM r{depth}),
        g{depth} AS (SELECT {path}, CASE WHEN whole THEN cap ELSE greatest(floor(w::DOUBLE * max(CASE WHEN NOT whole THEN lft / sw END) OVER ({by}))::BIGINT, 0) END AS budget FROM f{depth})""")
        given = f"g{depth}"
    return rf"""
        WITH docs AS (SELECT doc_id, text, {domain} AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s,
                             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents),
        leaves AS (SELECT d, l, s, sum(n)::BIGINT AS have FROM docs GROUP BY d, l, s),
        {",".join(ctes)},
        plan AS (SELECT d, l, s, budget // have AS whole, budget % have AS rest FROM leaves JOIN {given} USING (d, l, s) WHERE have > 0 AND budget > 0),
        keyed AS (SELECT docs.*, whole, rest, md5(concat_ws(':', '{seed}', whole, doc_id)) AS k FROM docs JOIN plan USING (d, l, s)),
        upto AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY k, doc_id, md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM keyed),
        kept AS (SELECT *, whole + (c <= rest)::INT AS times FROM upto)
        SELECT doc_id, d AS mix_domain, l AS mix_lang, s AS mix_source, n AS n_tokens, unnest(range(0, times))::INT AS epoch FROM kept WHERE times > 0
    """


#: Lower-cases A-Z alone.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def spelling_sql(thin: int, least_length: int = 6, least_count: int = 5, times: int = 5) -> str:
    """crc32 bit by bit over the bytes; near words share a text with one character left out."""
    crc = """xor(4294967295::BIGINT, list_reduce(list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::INT, 2))::BIGINT),
        lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(3988292384::BIGINT, y >> 1) ELSE y >> 1 END, xor(c, b)),
        4294967295::BIGINT))"""
    return rf"""
        WITH RECURSIVE r AS (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
        g AS (SELECT doc_id, r, count(*) AS n FROM r GROUP BY doc_id, r),
        x AS (SELECT r, n, {crc} AS h FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS hx FROM g)),
        w AS MATERIALIZED (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT n, CASE WHEN h % {thin} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM x)
            WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least_count}),
        d AS MATERIALIZED (
            SELECT word, n, length(word) AS size, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
        p AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
            UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
        b AS (SELECT word, count(*) AS n_near, max(near_n) AS top, first(near ORDER BY near_n DESC, near) AS near FROM p GROUP BY word),
        f AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= {times} * w.n THEN near END AS form, CASE WHEN top >= {times} * w.n THEN top END::BIGINT AS form_n
            FROM w LEFT JOIN b USING (word)),
        c AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.here = f.word WHERE f.form IS NOT NULL),
        t AS (SELECT word, arg_max(here, step) AS root FROM c GROUP BY word)
        SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word)
    """


def phrases_sql(least: int = 10, top: int = 2000) -> str:
    phrase = lambda k: " || ' ' || ".join(f"w[i{f' + {j}' if j else ''}]" for j in range(k))  # noqa: E731
    grams = ", ".join(f"g{k} AS (SELECT lang, {k} AS size, unnest(list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: {phrase(k)})) AS p FROM w)" for k in (1, 2, 3))
    score = "(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT"
    return rf"""
        WITH s AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?
-]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM s),
        {grams},
        f AS MATERIALIZED (SELECT lang, p, any_value(size) AS size, count(*)::BIGINT AS f FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3) GROUP BY lang, p),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, p, f AS a, size, string_split(p, ' ') AS w FROM f WHERE size > 1 AND f >= {least}),
        t AS (SELECT lang, w[1] || ' ' || w[2] AS p, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3),
        m AS (SELECT lang, p, max(a) AS longer FROM t GROUP BY lang, p),
        k AS (SELECT c.* FROM c LEFT JOIN m ON c.lang = m.lang AND c.p = m.p AND c.size = 2 WHERE m.longer IS NULL OR 100 * m.longer < 50 * a),
        q AS (SELECT lang, p, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS cut FROM k)),
        z AS (
            SELECT q.lang, q.p AS phrase, a, x.f AS l, y.f AS r, {score} AS score, row_number() OVER (PARTITION BY q.lang, q.p ORDER BY {score}, cut) AS best
            FROM q JOIN f x ON q.lang = x.lang AND q.lp = x.p JOIN f y ON q.lang = y.lang AND q.rp = y.p),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE best = 1)
        SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {top}
    """
