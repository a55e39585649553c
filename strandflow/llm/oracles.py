"""DuckDB SQL of the queries that SQL can express."""

#: Fixed values, stated here again so that the SQL doesn't lean on the operators.
CUT = r"(?s).+?(?:[.!?;:]\x20+|[gky0-9]\x20+|[a-c0-3][x-z7-9]|\z)"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK = r"[A-Za-z0-9+/=_]{24,}"
ENDPOINT = r"(?:https?://[A-Za-z0-9._:/-]+|(?:[A-Za-z0-9-]+\.)+(?:com|net|org|io)\b)"
SCOPE = 256

ORACLES = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_fingerprints": rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn FROM documents),
n AS (SELECT rn, doc_id, text, coalesce(lead(text) OVER (ORDER BY rn), first_value(text) OVER (ORDER BY rn)) AS nxt FROM o),
x AS (SELECT rn, doc_id, text, nxt, left(text, length(text) - CAST(length(text) // 2 AS bigint)) || left(nxt, CAST(length(text) // 2 AS bigint)) AS edited FROM n),
t AS MATERIALIZED (SELECT rn, side, list_transform(string_split(s, chr(10)), lambda p: CASE WHEN p = '' THEN [''] ELSE regexp_extract_all(p, '{CUT}') END) AS leaves
  FROM (SELECT rn, unnest(['a', 'b', 'c']) AS side, unnest([text, edited, nxt]) AS s FROM x)),
p AS MATERIALIZED (SELECT rn, side, list_transform(leaves, lambda v: sha256(array_to_string(list_transform(v, lambda s: sha256(s)), ','))) AS p FROM t),
b AS (SELECT rn, side, p, list_filter(range(1, len(p) + 1), lambda i: i = 1 OR left(p[i], 1) IN ('0', '1')) AS b FROM p),
f AS (SELECT rn, side, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda k: sha256(array_to_string(p[b[k]:coalesce(b[k+1] - 1, len(p))], ','))), ',')) AS root FROM b),
l AS MATERIALIZED (SELECT rn, side, s, count(*) AS c, count(*) * (length(s) + 1) AS w FROM (SELECT rn, side, unnest(flatten(leaves)) AS s FROM t) GROUP BY rn, side, s),
w AS (SELECT rn, side, sum(w) AS w FROM l GROUP BY ALL),
m AS (SELECT a.rn, o.side, sum(least(a.c, o.c) * (length(a.s) + 1)) AS m FROM l a JOIN l o ON o.rn = a.rn AND o.s = a.s AND a.side = 'a' AND o.side <> 'a' GROUP BY ALL),
q AS (SELECT a.rn, a.p AS pa, b.p AS pb, len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda i: a.p[1:i] = b.p[1:i])) AS h,
  len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda i: a.p[len(a.p)-i+1:] = b.p[len(b.p)-i+1:])) AS e FROM p a JOIN p b ON b.rn = a.rn AND a.side = 'a' AND b.side = 'b')
SELECT x.doc_id, length(x.text) AS n_chars, sha256(x.edited) AS edited_sha256, fa.root AS fingerprint, fb.root AS edited_fingerprint,
  2.0::double * coalesce(mb.m, 0) / (wa.w + wb.w) AS near_edited, 2.0::double * coalesce(mc.m, 0) / (wa.w + wc.w) AS near_next,
  h AS edit_from, len(pa) - least(e, least(len(pa), len(pb)) - h) AS edit_to
FROM x JOIN q ON q.rn = x.rn JOIN f fa ON fa.rn = x.rn AND fa.side = 'a' JOIN f fb ON fb.rn = x.rn AND fb.side = 'b'
  JOIN w wa ON wa.rn = x.rn AND wa.side = 'a' JOIN w wb ON wb.rn = x.rn AND wb.side = 'b' JOIN w wc ON wc.rn = x.rn AND wc.side = 'c'
  LEFT JOIN m mb ON mb.rn = x.rn AND mb.side = 'b' LEFT JOIN m mc ON mc.rn = x.rn AND mc.side = 'c'""",
}


def _found(pattern: str, kind: int, value: str = "0", least: int = 0) -> str:
    """A list of spans (s, k, e) of a text's matches, laid end to end from the pieces between them."""
    p = pattern.replace("'", "''")
    at = "CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))),0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))),0) AS bigint)"
    return f"""(SELECT list_filter(list_transform(range(1, len(hits)+1), lambda i: {{'s': {at}, 'k': {kind}, 'e': {at} + length(hits[i]), 'v': length(vals[i])}}), lambda m: m.v >= {least})
 FROM (SELECT string_split_regex(text, '{p}') gaps, regexp_extract_all(text, '{p}', 0) hits, regexp_extract_all(text, '{p}', {value}) vals))"""


def _secrets() -> str:
    shown = "array_to_string(list_transform({0}, lambda m: ['assign','access','hex','weak','endpoint'][m.k+1] || ':' || m.s || ':' || m.e), ',')"
    free = "list_filter({0}, lambda m: len(list_filter(base, lambda o: m.s < o.e AND o.s < m.e)) = 0)"
    near = lambda what: f"len(list_filter(found, lambda o: {what} AND abs(o.s - m.s) <= {SCOPE})) > 0"
    weak = f"list_filter(found, lambda m: m.k = 3 AND {near('o.k = 1')})"
    endpoint = f"list_filter(found, lambda m: m.k = 4 AND {near('o.k = 1')} AND ({near('o.k IN (0,2)')} OR len(list_filter(strong, lambda o: abs(o.s - m.s) <= {SCOPE})) > 0))"
    return f"""
WITH d AS (SELECT row_number() OVER () row_no, doc_id, coalesce(text,'') AS text FROM documents),
b AS (SELECT row_no, doc_id, text, {_found(ASSIGN, 0, '2', 6)} a, {_found(ACCESS, 1)} k, {_found(HEX, 2)} h FROM d),
c AS (SELECT *, a || k || h base, CASE WHEN len(k) > 0 THEN {_found(WEAK, 3)} ELSE [] END w, CASE WHEN len(k) > 0 THEN {_found(ENDPOINT, 4)} ELSE [] END n FROM b),
f AS (SELECT *, base || {free.format('w')} || {free.format('n')} AS found FROM c),
g AS (SELECT *, CASE WHEN len(k) > 0 THEN {weak} ELSE [] END AS strong FROM f),
l AS (SELECT *, base || strong || CASE WHEN len(k) > 0 THEN {endpoint} ELSE [] END AS every FROM g)
SELECT doc_id, CAST(len(a) AS bigint) n_assign, CAST(len(k) AS bigint) n_access, CAST(len(h) AS bigint) n_hex, sha256({shown.format('list_sort(base)')}) base_sha256, {shown.format('list_sort(every)')} spans FROM l"""


ORACLES["op6_secret_scan"] = _secrets()


def _manifest(levels: int = 8) -> str:
    """Trees of up to 16^levels leaves: each level hashes runs of 16 nodes of trees that have several."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS varchar)))::varchar || ':' || CAST({0} AS varchar) END".format
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit: each byte is added, then come eight steps
    bits = "list_transform(flatten(list_transform(string_split(CAST(doc_id AS varchar), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])), lambda x: CAST(x AS bigint))"
    step = "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: {step}), 4294967295)"
    out = f"""WITH d AS (SELECT *, coalesce('s' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t0 AS (SELECT tree, pos, leaf AS node FROM p)"""

    def climb(name: str) -> str:
        text = ""
        for i in range(levels):
            text += f""",
{name}n{i} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS whole, pos // 16 AS run, pos % 16 AS place FROM {name}{i}),
{name}s{i} AS MATERIALIZED (SELECT tree, run, list(node ORDER BY place) AS nodes FROM {name}n{i} WHERE whole > 1 GROUP BY tree, run),
{name}{i + 1} AS MATERIALIZED (SELECT tree, run AS pos, sha256(array_to_string(nodes, '')) AS node FROM {name}s{i} UNION ALL SELECT tree, pos, node FROM {name}n{i} WHERE whole = 1)"""
        return text

    out += climb("t") + f""",
u0 AS (SELECT 'all' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, node FROM t{levels})"""
    out += climb("u")
    out += f""",
w0 AS (SELECT p.*, s.node AS subroot, s.pos AS top, r.node AS root, '' AS proof, coalesce(claim, leaf) AS fold FROM p JOIN u0 s ON s.name = p.tree CROSS JOIN u{levels} r)"""
    step = 0
    for name, tree, pos in (("t", "w.tree", "pos"), ("u", "'all'", "top")):
        for i in range(levels):
            div = 16**i
            at = f"(w.{pos} // {div}) % 16"
            out += f""",
w{step + 1} AS (SELECT w.* EXCLUDE (proof, fold), proof || coalesce(array_to_string(nodes[1:{at}], '') || array_to_string(nodes[{at} + 2:], ''), '') AS proof,
  CASE WHEN nodes IS NULL THEN fold ELSE sha256(array_to_string(nodes[1:{at}], '') || fold || array_to_string(nodes[{at} + 2:], '')) END AS fold
  FROM w{step} w LEFT JOIN {name}s{i} s ON s.tree = {tree} AND s.run = w.{pos} // {div * 16})"""
            step += 1
    return out + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM w{step}"""


ORACLES["op11_dataset_manifest"] = _manifest()

ORACLES["op12_topk_search"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS bigint) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS int) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

ORACLES["op13_collocations"] = """
WITH t AS (SELECT row_number() OVER () AS d, doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, doc_id, regexp_extract_all(unnest(regexp_extract_all(text, '[^.,;:!?\\x0A-\\x0D]+')), '[^\\x20\\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS bigint) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.*, x.f AS l, y.f AS r, n.n, (1000::hugeint * a * n.n) // (x.f::hugeint * y.f) AS score FROM k JOIN n USING (lang) JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w))) AS i FROM c)) WHERE j - i + 1 < len(w) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR longer < b.a)
SELECT lang, row_number() OVER v AS rank, phrase, a, l, r, n, CAST(score AS bigint) AS score FROM z WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER v <= 2000"""
