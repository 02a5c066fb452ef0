"""The same queries as SQL for another engine, written on their own.

Each text names its relations as common table expressions; ``WITH`` lists are put together from what a query
needs. Nothing here is used by the engine.
"""

from __future__ import annotations

NOW = "TIMESTAMP '2001-08-02 00:00:00'"

#: name -> (relations it needs, its SELECT)
R: dict[str, tuple[str, str]] = {
    "files": ("", "SELECT s_suppkey AS file_id, r_name || '/' || n_name || '/' || s_name AS path, r_name || '/' || n_name AS dir, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS header FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey"),
    "funcs": ("files", """
        SELECT f.path, f.dir, f.file_id, f.header, p_partkey AS func_id, p_name AS name, x.loc, p_size::BIGINT AS ncloc, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE x.cog END AS cognitive,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size <= 3 END AS is_test, p_partkey % 3 <> 0 AS has_doc, p_brand || ':' || p_size AS shape,
               row_number() OVER (PARTITION BY f.path, p_name ORDER BY p_partkey) AS ord
        FROM (SELECT l_suppkey, l_partkey, (5 * sum(l_quantity))::BIGINT AS loc, sum(l_quantity * l_linenumber)::BIGINT AS cog FROM lineitem GROUP BY ALL) x
        JOIN part ON p_partkey = x.l_partkey JOIN files f ON f.file_id = x.l_suppkey"""),
    "functions": ("funcs", "SELECT *, path || '#' || name || CASE WHEN ord > 1 THEN '#' || ord ELSE '' END AS key FROM funcs"),
    "versions": ("functions", """
        SELECT f.key, f.path, x.idx, o_orderdate AS ts, CASE WHEN m[3] < 45 THEN floor(m[3] / 10) END AS digest
        FROM (SELECT l_orderkey AS idx, l_suppkey, l_partkey, max((l_linenumber, l_extendedprice, l_quantity)) AS m FROM lineitem GROUP BY ALL) x
        JOIN functions f ON f.file_id = x.l_suppkey AND f.func_id = x.l_partkey JOIN orders ON o_orderkey = x.idx"""),
    "edits": ("versions", "SELECT key, path, idx, epoch(ts::TIMESTAMP) // 86400 AS day FROM (SELECT *, lag(digest) OVER (PARTITION BY key ORDER BY idx) AS before FROM versions) WHERE digest IS NOT NULL AND digest IS DISTINCT FROM before"),
    "touches": ("files", "SELECT DISTINCT l_orderkey AS sha, path, o_orderdate AS ts, o_custkey AS author FROM lineitem JOIN files ON file_id = l_suppkey JOIN orders ON o_orderkey = l_orderkey"),
    "lines": ("files", """
        SELECT path, file_id, l_partkey AS func_id, o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice) AS line_no
        FROM lineitem JOIN files ON file_id = l_suppkey JOIN orders ON o_orderkey = l_orderkey"""),
    "edges": ("", """
        SELECT DISTINCT src, dst FROM (
          SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS src, l_partkey AS dst FROM lineitem
        ) WHERE src <> dst"""),
    "nodes": ("", "SELECT p_partkey AS node, p_brand AS dir, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size <= 3 END AS is_test, p_brand || ':' || p_size AS shape FROM part"),
    "degs": ("nodes edges", """
        SELECT n.node, (SELECT count(*) FROM edges e WHERE e.dst = n.node) AS callers, (SELECT count(*) FROM edges e WHERE e.src = n.node) AS calls,
               CASE WHEN n.is_test IS NULL THEN NULL ELSE (SELECT count(*) FROM edges e JOIN nodes s ON s.node = e.src WHERE e.dst = n.node AND s.is_test IS DISTINCT FROM true) END AS dependents
        FROM nodes n"""),
    "walk": ("nodes edges", """
        SELECT e.dst AS node FROM edges e JOIN nodes s ON s.node = e.src JOIN nodes d ON d.node = e.dst WHERE s.is_test AND d.is_test IS DISTINCT FROM true
        UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node JOIN nodes d ON d.node = e.dst WHERE d.is_test IS DISTINCT FROM true"""),
    "tested": ("walk nodes", "SELECT node, CASE WHEN is_test IS NULL THEN NULL WHEN node IN (SELECT node FROM walk) THEN 1 ELSE 0 END AS under_test FROM nodes"),
    "banded": ("functions", "SELECT *, CASE WHEN ncloc <= 14 THEN 0 WHEN ncloc <= 24 THEN 1 WHEN ncloc <= 49 THEN 2 ELSE 3 END AS band FROM functions"),
    "counted": ("banded", "SELECT band, count(cognitive) AS n FROM banded GROUP BY band"),
    # sizes end at 50, so only the top band can be thin at the test's sizes
    "merged": ("banded counted", "SELECT b.*, CASE WHEN band = 3 AND (SELECT n FROM counted WHERE band = 3) < 30 THEN 2 ELSE band END AS own FROM banded b"),
    "medians": ("merged", "SELECT own AS band, count(*) AS members, list_sort(list(cognitive))[(count(*) // 2 + 1)::INT] AS median FROM merged WHERE cognitive IS NOT NULL GROUP BY own"),
    "tangled": ("merged medians", """
        SELECT m.*, d.median, CASE WHEN m.cognitive IS NOT NULL THEN least(greatest((m.cognitive / greatest(d.median, 1)::DOUBLE - 1) / 3.0, 0), 1) END AS tangle, least(m.cognitive / 15.0::DOUBLE, 1) AS raw, m.cognitive / greatest(d.median, 1)::DOUBLE AS times
        FROM merged m LEFT JOIN medians d ON d.band = m.own"""),
    "reads": ("", """
        SELECT doc_id AS reading_id, ['full', 'most', 'some', 'none'][1 + 2 * (1 - quality) + toxic] AS predicted, toxic = 1 AS trap, doc_id % 4 = 0 AS derivable, quality = 0 AS surprised,
               'm' || doc_id % 3 AS model, doc_id % 10 AS position, doc_id % 5 = 0 AS stale FROM labels"""),
    "graded": ("reads", "SELECT *, CASE WHEN reading_id % 6 = 0 THEN NULL ELSE predicted END AS documented, CASE WHEN reading_id % 5 = 1 THEN NULL ELSE predicted END AS legible FROM reads"),
    "func_reads": ("functions graded", "SELECT f.key AS func_key, g.* FROM functions f JOIN graded g ON g.reading_id = (f.func_id * 31 + f.file_id) % (SELECT count(*) FROM documents)"),
    "own_history": ("lines", "SELECT path, func_id, epoch(NOW - min(ts)) / 86400.0 AS age, epoch(NOW - max(ts)) / 86400.0 AS touched, count(DISTINCT CASE WHEN ts::DATE > NOW::DATE - 30 THEN commit END) AS commits, count(DISTINCT author) AS headcount FROM lines GROUP BY ALL"),
    "file_history": ("lines", "SELECT path, epoch(NOW - min(ts)) / 86400.0 AS age, epoch(NOW - max(ts)) / 86400.0 AS touched, count(DISTINCT CASE WHEN ts::DATE > NOW::DATE - 30 THEN commit END) AS commits, count(DISTINCT author) AS headcount FROM lines GROUP BY ALL"),
    "repo": ("lines", "SELECT count(DISTINCT author) AS repo_headcount, epoch(NOW - min(ts)) / 86400.0 AS repo_age FROM lines"),
    "file_sums": ("functions", "SELECT path, sum(loc) AS loc, sum(ncloc) AS ncloc, count(*) FILTER (WHERE is_test IS DISTINCT FROM true) AS funcs, sum(cognitive) AS cognitive, bool_or(has_doc) AS has_doc FROM functions GROUP BY path"),
    "clone_sizes": ("nodes", "SELECT shape, count(*) AS clone_count FROM nodes GROUP BY shape HAVING count(*) > 1"),
    "facts": ("tangled file_sums degs tested own_history file_history repo clone_sizes func_reads", """
        SELECT f.key, 'func' AS kind, f.path, f.func_id AS line, f.loc::DOUBLE AS loc, f.ncloc::DOUBLE AS ncloc, NULL::DOUBLE AS funcs, callers, calls, clone_count, f.cognitive, tangle, h.age, h.touched, h.commits,
               CASE WHEN r.func_key IS NULL THEN 0 ELSE 1 END AS read, MAP {'full': 0.08, 'most': 0.30, 'some': 0.62, 'none': 0.92}[predicted] AS surprise,
               CASE WHEN derivable THEN 0.0 ELSE MAP {'full': 0.95, 'most': 0.70, 'some': 0.35, 'none': 0.0}[documented] END AS doc_relevant,
               f.has_doc::INT AS doc_present, under_test, dependents, header, MAP {'full': 0.08, 'most': 0.30, 'some': 0.62, 'none': 0.92}[legible] AS illegible, h.headcount, s.loc AS file_loc, s.funcs AS file_funcs,
               fh.headcount AS file_headcount, repo_headcount, repo_age, trap::INT AS trap
        FROM tangled f JOIN file_sums s USING (path) LEFT JOIN degs d ON d.node = f.func_id LEFT JOIN tested t ON t.node = f.func_id LEFT JOIN own_history h ON h.path = f.path AND h.func_id = f.func_id
        LEFT JOIN file_history fh ON fh.path = f.path LEFT JOIN clone_sizes c ON c.shape = f.shape LEFT JOIN func_reads r ON r.func_key = f.key, repo
        WHERE f.is_test IS DISTINCT FROM true
        UNION ALL
        SELECT s.path, 'file', s.path, NULL, s.loc, s.ncloc, s.funcs, NULL, NULL, NULL, s.cognitive, NULL, age, touched, commits, 0, NULL, NULL, has_doc::INT, NULL, NULL, NULL, NULL, headcount, NULL, NULL, NULL, repo_headcount, repo_age, NULL
        FROM file_sums s LEFT JOIN file_history h USING (path), repo"""),
    "deltas": ("files", """
        SELECT l_orderkey AS idx, o_orderdate AS ts, l_suppkey || ':' || l_partkey AS func_id, l_suppkey, path, CASE WHEN x.f = 'R' THEN 'del' ELSE 'set' END AS op, x.q::BIGINT AS loc
        FROM (SELECT l_orderkey, l_suppkey, l_partkey, arg_max({'q': l_quantity, 'f': l_returnflag}, (l_linenumber, l_extendedprice)) AS x FROM lineitem GROUP BY ALL)
        JOIN orders ON o_orderkey = l_orderkey JOIN files ON file_id = l_suppkey"""),
    "state": ("deltas", "SELECT func_id, path, loc FROM deltas WHERE idx <= 9000 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) = 1 AND op = 'set'"),
    "older": ("deltas", "SELECT func_id, path, loc FROM deltas WHERE idx <= 5000 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) = 1 AND op = 'set'"),
    "sized": ("tangled func_reads own_history", """
        SELECT f.path, f.key, f.loc, f.ncloc, f.cognitive, f.has_doc, coalesce(MAP {'full': 0.08, 'most': 0.30, 'some': 0.62, 'none': 0.92}[predicted], 0.5) AS surprise,
               coalesce(MAP {'full': 0.95, 'most': 0.70, 'some': 0.35, 'none': 0.0}[documented], 0.0) AS documented, f.func_id % 10 / 10.0 AS churn, h.age, h.touched, r.func_key IS NOT NULL AS read, tangle,
               f.func_id % 4 AS callers, f.func_id % 5 AS calls, split_part(f.path, '/', 1) AS d1, split_part(f.path, '/', 1) || '/' || split_part(f.path, '/', 2) AS d2, greatest(f.loc, 1) AS w
        FROM tangled f LEFT JOIN func_reads r ON r.func_key = f.key LEFT JOIN own_history h ON h.path = f.path AND h.func_id = f.func_id"""),
    # every function under its file and each directory above
    "under": ("sized", "SELECT s.*, unnest([s.path, d2, d1, '']) AS node FROM sized s"),
    "bodies": ("", r"SELECT doc_id, source, b.text AS doc, d.text AS body, split_part(d.text, chr(10), 1) AS signature FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40"),
    "subjects": ("", "SELECT doc_id AS id, source AS path, n_chars FROM documents"),
}

STRUCTURAL = (
    "let const var fun func def fn return self this new null nil none true false and not the for while loop match case else elif then async await type class struct "
    "enum impl pub use import from export default static mut ref int str string bool err error res result ret val value out tmp obj args arg opts opt param params"
)


def words(text: str) -> str:
    """List of distinct vocabulary words of a text."""
    humps = r"'([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'"
    # a second pass splits what the first match consumed
    apart = f"regexp_replace(regexp_replace({text}, {humps}), {humps})"
    plain = r"'[^\p{L}\p{N}]+', ' ', 'g'"
    return f"list_distinct(list_filter(string_split(lower(regexp_replace({apart}, {plain})), ' '), lambda w: strlen(w) >= 3 AND NOT list_contains(string_split('{STRUCTURAL}', ' '), w)))"


def sql(needs: str, select: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for n in R[name][0].split():
            if n != name:
                need(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        need(n)
    ctes = ", ".join(f"{n} AS ({R[n][1]})" for n in order)
    return (f"WITH RECURSIVE {ctes} {select}" if ctes else select).replace("NOW", NOW)


SHIPPED = {
    "giant-function": ("func", "loc >= 200 AND tangle >= 0.25 AND read < 1", "loc", "tangle >= 0.25 AND read < 1", 1),
    "giant-illegible": ("func", "loc >= 200 AND illegible >= 0.6", "loc", "illegible >= 0.6", 1),
    "crowded-file": ("file", "funcs >= 40 AND doc_present < 1 AND read < 1", "funcs", "doc_present < 1 AND read < 1", 1),
    "crowded-unpredictable": ("file", "funcs >= 40 AND surprise >= 0.6", "funcs", "surprise >= 0.6", 1),
    "load-bearing-unread": ("func", "dependents >= 20 AND read < 1 AND ncloc >= 10", "dependents", "read < 1 AND ncloc >= 10", 1),
    "knotty-load-bearing": ("func", "tangle >= 0.8 AND dependents >= 10 AND ncloc >= 10", "dependents", "tangle >= 0.8 AND ncloc >= 10", 1),
    "load-bearing-illegible": ("func", "illegible >= 0.6 AND dependents >= 10 AND ncloc >= 10", "dependents", "illegible >= 0.6 AND ncloc >= 10", 1),
    "load-bearing-undocumented": ("func", "doc_present < 1 AND dependents >= 10 AND ncloc >= 10", "dependents", "doc_present < 1 AND ncloc >= 10", 1),
    "undocumented-declaration": ("func", "header >= 1 AND doc_present < 1 AND dependents >= 10 AND ncloc < 10", "doc_present", "header >= 1 AND dependents >= 10 AND ncloc < 10", -1),
    "load-bearing-untested": ("func", "under_test < 1 AND surprise >= 0.6 AND dependents >= 10 AND ncloc >= 10", "dependents", "under_test < 1 AND surprise >= 0.6 AND ncloc >= 10", 1),
    "surprising-changing": ("func", "surprise >= 0.6 AND commits >= 4 AND ncloc >= 10", "commits", "surprise >= 0.6 AND ncloc >= 10", 1),
    "surprising-far-reaching": ("func", "surprise >= 0.6 AND calls >= 10 AND ncloc >= 10", "calls", "surprise >= 0.6 AND ncloc >= 10", 1),
    "stale-doc": ("func", "doc_relevant >= 0.7 AND surprise >= 0.9 AND ncloc >= 10", "surprise", "doc_relevant >= 0.7 AND ncloc >= 10", 1),
    "trap-being-edited": ("func", "trap >= 1 AND commits >= 3 AND ncloc >= 10", "commits", "trap >= 1 AND ncloc >= 10", 1),
    "fossil-trap": ("func", "repo_age >= 730 AND trap >= 1 AND touched >= 1095 AND ncloc >= 10", "trap", "repo_age >= 730 AND touched >= 1095 AND ncloc >= 10", 1),
    "clone-being-edited": ("func", "clone_count >= 3 AND commits >= 2 AND ncloc >= 10", "commits", "clone_count >= 3 AND ncloc >= 10", 1),
    "widely-cloned": ("func", "clone_count >= 4 AND ncloc >= 30", "ncloc", "clone_count >= 4", 1),
    "fossil": ("func", "repo_age >= 1095 AND touched >= 1825 AND ncloc >= 100", "touched", "repo_age >= 1095 AND ncloc >= 100", 1),
    "tangled-for-size": ("func", "tangle >= 0.8 AND ncloc >= 40 AND read < 1", "ncloc", "tangle >= 0.8 AND read < 1", 1),
    "tangled-illegible": ("func", "tangle >= 0.8 AND illegible >= 0.6 AND ncloc >= 40", "ncloc", "tangle >= 0.8 AND illegible >= 0.6", 1),
    "sole-author": ("func", "repo_headcount >= 4 AND headcount <= 1 AND dependents >= 10 AND ncloc >= 10", "dependents", "repo_headcount >= 4 AND headcount <= 1 AND ncloc >= 10", 1),
    "sole-author-coordinator": ("func", "repo_headcount >= 4 AND headcount <= 1 AND calls >= 10 AND ncloc >= 10", "calls", "repo_headcount >= 4 AND headcount <= 1 AND ncloc >= 10", 1),
    "alone-in-shared-code": ("func", "file_headcount >= 6 AND headcount <= 1 AND ncloc >= 20", "ncloc", "file_headcount >= 6 AND headcount <= 1", 1),
    "lone-file": ("file", "repo_headcount >= 6 AND funcs >= 5 AND headcount <= 2", "funcs", "repo_headcount >= 6 AND headcount <= 2", 1),
    "crowded-and-knotty": ("func", "headcount >= 4 AND tangle >= 0.8 AND ncloc >= 10", "headcount", "tangle >= 0.8 AND ncloc >= 10", 1),
}
HITS = " UNION ALL ".join(f"SELECT '{i}' AS rule, key, path, loc FROM facts WHERE kind = '{pop}' AND {where}" for i, (pop, where, *_) in SHIPPED.items())
R["hits"] = ("facts", HITS)
R["alone"] = ("hits", "SELECT key, min(rule) AS rule FROM hits GROUP BY key HAVING count(*) = 1")
R["only_counts"] = ("hits alone", "SELECT rule, count(*) AS hits, (SELECT count(*) FROM alone a WHERE a.rule = h.rule) AS alone_n FROM hits h GROUP BY rule")
R["calibration"] = ("facts", " UNION ALL ".join(
    f"SELECT '{i}' AS rule, list_sort(list({f}::DOUBLE), '{'DESC' if up > 0 else 'ASC'}')[8] AS value FROM facts WHERE kind = '{pop}' AND {rest} AND {f} IS NOT NULL HAVING count(*) >= 8"
    for i, (pop, _, f, rest, up) in SHIPPED.items()
))
R["decided"] = ("functions", """
    SELECT key, loc, ['false-positive', 'fine-for-now', 'fine-always', 'flag'][1 + func_id % 4] AS verdict, func_id % 3 = 0 AS altered, func_id % 5 < 2 AS known,
           func_id FROM functions WHERE loc >= 200""")  # fmt: skip
R["shown"] = ("decided", "SELECT *, known AND (verdict = 'fine-always' OR verdict = 'false-positive' OR (verdict = 'fine-for-now' AND NOT altered)) AS hidden FROM decided")
R["call_words"] = ("", r"""
    SELECT conv_id, turn, w.name, w.pos FROM (
      SELECT conv_id, turn, unnest(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: len(x) > 2), lambda x, i: {'name': x, 'pos': i - 1})) AS w FROM conversations
    )""")  # fmt: skip
R["calls_"] = ("call_words", "SELECT -1 - conv_id AS caller, turn || ':' || pos AS call_id, name, CASE WHEN pos % 4 = 0 THEN 'o' || pos % 3 END AS qualifier, 'd' || conv_id % 3 || '/f' || conv_id % 7 AS path, 'd' || conv_id % 3 AS dir, conv_id % 5 = 0 AS in_test FROM call_words")
R["defs_"] = ("calls_", """
    SELECT k * 4 + i AS key, name, CASE WHEN (k + i) % 2 = 0 THEN 'o' || (k + i) % 3 END AS owner, 'd' || (k + i) % 3 || '/f' || (k + i) % 7 AS path, 'd' || (k + i) % 3 AS dir, (k + i) % 4 <> 0 AS exported, (k + i) % 11 = 0 AS contract_test
    FROM (SELECT name, k, unnest(range(k % 3 + 1)) AS i FROM (SELECT DISTINCT name, ('0x' || substr(md5(name), 1, 6))::BIGINT AS k FROM calls_))""")  # fmt: skip
R["tiers"] = ("calls_ defs_", """
    SELECT c.caller, c.call_id, d.key AS callee, CASE WHEN c.qualifier = d.owner THEN 0 WHEN c.path = d.path THEN 1 WHEN c.dir = d.dir THEN 2 ELSE 3 END AS tier, count(*) OVER (PARTITION BY c.caller, c.call_id) AS n
    FROM calls_ c JOIN defs_ d ON c.name = d.name WHERE (d.exported OR c.path = d.path) AND (NOT d.contract_test OR c.in_test)""")  # fmt: skip
R["resolved"] = ("tiers", "SELECT caller, call_id, callee FROM (SELECT *, min(tier) OVER (PARTITION BY caller, call_id) AS best FROM tiers) WHERE tier = best AND (tier < 3 OR n = 1) AND caller <> callee")

FIELDS = "loc ncloc callers calls clone_count cognitive tangle age touched commits read surprise doc_relevant doc_present under_test dependents header illegible headcount file_loc file_funcs file_headcount repo_headcount repo_age trap".split()
SPREAD = "loc ncloc cognitive callers calls dependents commits headcount touched".split()


def lens(x: str, bands: list[tuple[float, str]]) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' " + " ".join(f"WHEN {x} >= {low} THEN '{name}'" for low, name in reversed(bands)) + " ELSE 'unknown' END"


def tally(by: str) -> str:
    sums = [f"count(*) FILTER (WHERE {a} = '{g}') AS {a}_{g}" for a in ("predicted", "documented", "legible") for g in ("full", "most", "some", "none")]
    sums += [f"count(*) FILTER (WHERE {a} IS NULL) AS {a}_ungraded" for a in ("predicted", "documented", "legible")]
    sums += [f"count(*) FILTER (WHERE {a}) AS {n}" for a, n in (("trap", "traps"), ("surprised", "surprised"), ("derivable", "derivable"), ("stale", "stale"))]
    return sql("graded", f"SELECT {by + ',' if by else ''} count(*) AS readings, {', '.join(sums)} FROM graded {'GROUP BY ' + by if by else ''}")


MAIN = "SELECT path, arg_max(author, (n, first)) AS main_author, count(*) AS headcount FROM (SELECT path, author, count(*) AS n, min(line_no) AS first FROM lines GROUP BY ALL) GROUP BY path"

#: What a file a part holds, by its language, depth, length and chain.
PARSED = """
        WITH l AS (SELECT *, ['rust', 'go', 'javascript', 'typescript', 'java', 'csharp', 'c', 'cpp', 'dart', 'kotlin', 'scala', 'swift', 'php', 'ruby', 'lua', 'julia', 'python', 'gdscript'][p_partkey % 18 + 1] AS lang,
                          (p_size % 4)::BIGINT AS deep, (p_size % 5 + 6)::BIGINT AS long, p_partkey % 3 AS chain FROM part),
        w AS (SELECT *, lang NOT IN ('swift', 'lua', 'julia', 'gdscript') AS logic,
                     3 + deep + long + 2 + 2 * chain + 2 + CASE WHEN lang IN ('python', 'gdscript') THEN 0 ELSE deep + 2 END AS loc FROM l)"""

#: What happens to a file a supplier, and the lives of its names.
PATHS = """
        WITH x AS (SELECT l_suppkey AS file, l_orderkey AS idx, max((l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag)) AS m FROM lineitem GROUP BY ALL),
        y AS (SELECT file, idx, m[4] AS qty, m[5] AS flag, m[4] >= 47 AS gone FROM x),
        z AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY file ORDER BY idx), true) AS fresh FROM y),
        o AS (SELECT *, CASE WHEN gone AND fresh THEN 'add' WHEN gone THEN 'delete' WHEN fresh THEN 'add' WHEN flag = 'R' THEN 'rename' ELSE 'modify' END AS op FROM z),
        n AS (SELECT *, sum(CASE WHEN op = 'rename' THEN 1 ELSE 0 END) OVER w AS n, lag(op) OVER w AS was FROM o WINDOW w AS (PARTITION BY file ORDER BY idx)),
        s AS (SELECT *, 'f' || file || '~' || n::BIGINT AS path, op <> 'delete' AND (op = 'rename' OR was IS NULL OR was = 'delete') AS starts FROM n),
        l AS (SELECT *, sum(CASE WHEN starts AND op <> 'rename' THEN 1 ELSE 0 END) OVER w AS chain, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS life, min(CASE WHEN op IN ('rename', 'delete') THEN idx END) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM s WINDOW w AS (PARTITION BY file ORDER BY idx)),
        f AS (SELECT file, chain, life, path, idx AS born, ends AS died, first_value(path) OVER c AS origin_path, first_value(idx) OVER c AS origin_born, (row_number() OVER c - 1)::BIGINT AS renames FROM l WHERE starts WINDOW c AS (PARTITION BY file, chain ORDER BY idx)),
        lives AS (SELECT path, born, died, origin_path, origin_born, renames FROM f UNION ALL
                  SELECT path || '~c' || idx, idx, NULL, path || '~c' || idx, idx, 0 FROM s WHERE qty <= 2 AND op <> 'delete')"""
#: The commits' parents, and what the banked heads and the last commit reach.
ANCESTRY = """
        WITH RECURSIVE p AS (
          SELECT sha, parent FROM (SELECT o_orderkey AS sha, lag(o_orderkey) OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) AS parent FROM orders) WHERE parent IS NOT NULL
          UNION ALL SELECT sha, parent FROM (SELECT o_orderkey AS sha, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS parent FROM orders) WHERE sha % 100 = 0 AND parent IS NOT NULL),
        banked AS (SELECT max(o_orderkey) AS head FROM orders WHERE o_orderdate < '2000-01-01' GROUP BY o_orderpriority UNION ALL SELECT -7),
        top AS (SELECT max(o_orderkey) AS top FROM orders),
        reach AS (SELECT head, head AS sha FROM banked WHERE head > 0 UNION SELECT top, top FROM top UNION SELECT r.head, p.parent FROM reach r JOIN p ON p.sha = r.sha)"""

ORACLES: dict[str, str] = {
    "edits_per_function": sql("edits", "SELECT key, " + ", ".join(f"sum(CASE WHEN day > epoch(NOW) // 86400 - {w} THEN 1 ELSE 0 END)::BIGINT AS w{k}" for k, w in enumerate((30, 365, 1500))) + " FROM edits GROUP BY key"),
    "edited_facts": sql("edits", """
        SELECT f.key, 'func' AS kind, k.n AS commits FROM functions f LEFT JOIN (SELECT key, sum(CASE WHEN day > epoch(NOW) // 86400 - 1500 THEN 1 ELSE 0 END)::BIGINT AS n FROM edits GROUP BY key) k USING (key) WHERE f.is_test IS DISTINCT FROM true
        UNION ALL SELECT p.path, 'file', (SELECT sum(CASE WHEN day > epoch(NOW) // 86400 - 1500 THEN 1 ELSE 0 END)::BIGINT FROM (SELECT DISTINCT path, idx, day FROM edits) e WHERE e.path = p.path) FROM (SELECT DISTINCT path FROM functions) p"""),
    "as_of_readings": """
        WITH x AS (SELECT l_orderkey AS idx, l_suppkey || ':' || l_partkey AS func_id, max((l_linenumber, l_extendedprice, l_quantity, l_returnflag)) AS m FROM lineitem GROUP BY ALL),
        d AS (SELECT idx, func_id, CASE WHEN m[4] = 'R' THEN 'del' ELSE 'set' END AS op, m[3]::BIGINT AS loc FROM x),
        a AS (SELECT func_id, idx + 250 AS idx, idx AS since FROM d WHERE idx % 100 = 0)
        SELECT a.func_id, a.idx, a.since, d.op, d.loc FROM a ASOF JOIN d ON a.func_id = d.func_id AND a.idx >= d.idx""",
    "kept_pages": r"""
        WITH p AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/') AS path FROM pages WHERE url LIKE '%://%'),
        s AS (SELECT *, string_split(path, '/') AS c FROM p),
        q AS (SELECT *, c[1] AS host, c[2] AS lang, c[len(c)] AS name FROM s)
        SELECT page_id, path FROM q
        WHERE NOT (len(c) > 1 AND host LIKE 'm.%') AND NOT (len(c) > 2 AND lang = 'fr') AND NOT (len(c) > 1 AND host = 'fr')
          AND NOT (CASE WHEN len(c) > 1 AND host LIKE 'blog.%' AND len(c) = 3 AND lang = 'en' AND regexp_matches(name, '^3.$') THEN false
                        WHEN len(c) > 1 AND host LIKE 'blog.%' AND regexp_matches(name, '^[0-4]') THEN true
                        WHEN name LIKE '%.html' THEN NOT (len(c) = 3 AND lang = 'en') ELSE false END)""",
    "rollup_after_readings": sql("sized", """
        , n AS (SELECT path, d1, d2, loc, w, age, touched, told, CASE WHEN told THEN 0.92 ELSE surprise END AS surprise, CASE WHEN told THEN 0.95 ELSE documented END AS documented, told OR read AS read FROM (SELECT *, loc % 3 = 0 AND loc % 2 <> 0 AS told FROM sized)),
        u AS (SELECT *, unnest([path, d2, d1, '']) AS node FROM n)
        SELECT node AS path, sum(loc)::BIGINT AS loc, count(*) AS funcs, round(sum(w * surprise) / sum(w), 6) AS surprise, round(sum(w * documented) / sum(w), 6) AS documented, round(sum(CASE WHEN read THEN w ELSE 0 END) / sum(w), 6) AS analysed_share,
               round(CASE WHEN bool_or(read) THEN sum(CASE WHEN read AND surprise > 0.5 THEN w ELSE 0 END) / sum(CASE WHEN read THEN w ELSE 0 END) END, 6) AS hot_share, round(max(age), 6) AS age, round(min(touched), 6) AS touched, round(max(surprise), 6) AS top_surprise
        FROM u GROUP BY node"""),
    "reading_summary": sql("functions", """
        , r AS (SELECT f.key, coalesce(f.header = 1, false) AS out, doc_id, quality, toxic FROM functions f LEFT JOIN labels ON doc_id = (f.func_id * 31 + f.file_id) % (SELECT count(*) FROM documents)),
        g AS (SELECT key, out, doc_id IS NOT NULL AS has, doc_id % 5 = 0 AS stale, toxic = 1 AS trap, CASE WHEN quality = 1 AND toxic = 0 THEN 'full' WHEN quality = 1 THEN 'most' WHEN toxic = 0 THEN 'some' ELSE 'none' END AS plain, doc_id, quality FROM r),
        h AS (SELECT *, has AND NOT stale AND NOT out AS rd, CASE WHEN doc_id % 9 <> 0 THEN plain WHEN quality = 0 THEN 'none' ELSE 'full' END AS grade, CASE WHEN doc_id % 5 <> 1 THEN plain END AS legible FROM g)
        SELECT count(*) FILTER (WHERE NOT out) AS functions, count(*) FILTER (WHERE out) AS excluded, count(*) FILTER (WHERE rd) AS read, count(*) FILTER (WHERE has AND stale AND NOT out) AS stale,
               count(*) FILTER (WHERE NOT out AND NOT has) AS unread, count(*) FILTER (WHERE rd AND trap) AS traps, """ + ", ".join(f"count(*) FILTER (WHERE rd AND {c} = '{g}') AS {n}_{g}" for n, c in (("predicted", "grade"), ("legible", "legible")) for g in ("full", "most", "some", "none")) + " FROM h"),
    "frame_tree": sql("deltas", """
        , a AS (SELECT func_id, path, loc, op, idx FROM deltas WHERE idx <= 9000 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) = 1),
        b AS (SELECT func_id, path, op FROM deltas WHERE idx <= 8800 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) = 1),
        j AS (SELECT coalesce(a.path, b.path) AS path, a.op = 'set' AS now, coalesce(b.op = 'set', false) AS was, a.loc, a.idx > 8800 AS moved FROM a LEFT JOIN b USING (func_id)),
        n AS (SELECT path, now::INT AS functions, CASE WHEN now THEN loc ELSE 0 END AS lines, was::INT AS before, (now AND NOT was OR now AND moved OR was AND NOT now)::INT AS news FROM j WHERE now OR was),
        u AS (SELECT *, unnest([path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1), '']) AS node FROM n)
        SELECT node AS path, CASE WHEN node = min(path) AND node <> '' AND node LIKE '%/%/%' THEN 'file' ELSE 'dir' END AS kind, sum(functions)::BIGINT AS functions, sum(lines)::BIGINT AS lines, sum(before) = 0 AS appeared, sum(before) > 0 AND sum(news) > 0 AS edited
        FROM u GROUP BY node HAVING sum(functions) > 0"""),
    "scoped_facts": sql("facts functions", "SELECT key, kind, round(loc::DOUBLE, 6) AS loc, round(callers::DOUBLE, 6) AS callers, round(tangle::DOUBLE, 6) AS tangle FROM facts WHERE key NOT IN (SELECT key FROM functions WHERE header = 1) AND key NOT IN (SELECT path FROM functions WHERE header = 1)"),
    "neighbour_listing": sql("nodes edges", """
        , n AS (SELECT 'caller' AS side, src AS node FROM edges WHERE dst = 1 UNION ALL SELECT 'callee', dst FROM edges WHERE src = 1 UNION ALL SELECT 'clone', node FROM nodes WHERE node <> 1 AND shape = (SELECT shape FROM nodes WHERE node = 1))
        SELECT side, dir AS path, bool_or(dir = (SELECT dir FROM nodes WHERE node = 1)) AS here, count(*) AS nodes, min(name) AS first FROM n JOIN nodes USING (node) GROUP BY side, dir"""),
    "changed_files": sql("deltas", """
        , a AS (SELECT path, sum(loc) AS size, max(idx) AS time FROM (SELECT * FROM deltas WHERE idx <= 60 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) = 1) WHERE op = 'set' GROUP BY path),
        b AS (SELECT path, sum(loc) AS size, max(idx) AS time FROM (SELECT * FROM deltas WHERE idx <= 9000 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) = 1) WHERE op = 'set' GROUP BY path)
        SELECT path, CASE WHEN a.size IS NULL THEN 'added' WHEN b.size IS NULL THEN 'gone' ELSE 'changed' END AS op FROM a FULL JOIN b USING (path) WHERE a.size IS NULL OR b.size IS NULL OR a.size <> b.size OR a.time <> b.time"""),
    "line_range_history": """
        WITH RECURSIVE x AS (SELECT l_suppkey AS file, l_orderkey AS idx, max((l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
        h AS (SELECT file, idx, m[2] % 90 + 2 AS pos, (m[1] % 4)::BIGINT AS ol, (m[4] % 6)::BIGINT AS nl FROM x),
        g AS (SELECT *, pos + nl - 1 AS last, row_number() OVER (PARTITION BY file ORDER BY idx DESC) AS k FROM h WHERE ol > 0 OR nl > 0),
        r AS (
          SELECT s_suppkey AS file, ask, 1::BIGINT AS k, s_suppkey % 50 + 1 + 30 * ask AS s, s_suppkey % 50 + 11 + 31 * ask AS e, NULL::BIGINT AS idx, NULL::BIGINT AS was_s, NULL::BIGINT AS was_e, NULL::BIGINT AS added, NULL::BIGINT AS removed, false AS met
          FROM supplier, (VALUES (0), (1)) a(ask)
          UNION ALL
          SELECT file, ask, k + 1,
                 CASE WHEN last < s THEN s + ol - nl WHEN nl > 0 AND pos <= s THEN pos ELSE s END,
                 CASE WHEN last < e THEN e + ol - nl WHEN nl > 0 AND pos <= e THEN pos + ol - 1 ELSE e END,
                 idx, s, e, greatest(least(last, e) - greatest(pos, s) + 1, 0),
                 CASE WHEN (nl > 0 AND pos <= e AND last >= s) OR (nl = 0 AND pos > s AND pos <= e) THEN ol ELSE 0 END,
                 (nl > 0 AND pos <= e AND last >= s) OR (nl = 0 AND pos > s AND pos <= e)
          FROM (SELECT r.file, ask, r.k, s, e, g.idx, pos, ol, nl, last FROM r JOIN g ON g.file = r.file AND g.k = r.k WHERE s <= e)
        )
        SELECT file::VARCHAR AS file, ask::VARCHAR AS ask, idx, was_s AS start, was_e AS "end", added, removed, s > e AS began FROM r WHERE met""",
    "path_lives": PATHS + " SELECT * FROM lives",
    "path_lives_in_halves": PATHS + " SELECT path, born, origin_path, origin_born, renames FROM lives WHERE died IS NULL",
    "history_over_renames": PATHS + """,
        t AS (SELECT l.file, l.chain, l.idx FROM l WHERE op <> 'delete'),
        k AS (SELECT file, chain, count(*) AS commits, min(idx) AS first_idx, max(idx) AS last_idx FROM t GROUP BY ALL)
        SELECT f.path, commits, first_idx, last_idx, renames FROM f JOIN k USING (file, chain) WHERE died IS NULL
        UNION ALL SELECT path, 1, born, born, 0 FROM lives WHERE path LIKE '%~c%'""",
    "history_carried": ANCESTRY + """,
        mine AS (SELECT sha FROM reach, top WHERE head = top), had AS (SELECT head, count(*) AS n, count(*) FILTER (WHERE sha IN (SELECT sha FROM mine)) AS shared FROM reach GROUP BY head)
        SELECT b.head, CASE WHEN b.head = top THEN 'same' WHEN b.head IN (SELECT sha FROM mine) THEN 'grown' ELSE 'rewritten' END AS state,
               (SELECT count(*) FROM mine) - CASE WHEN b.head = top THEN (SELECT count(*) FROM mine) WHEN b.head IN (SELECT sha FROM mine) THEN n ELSE 0 END AS ahead
        FROM banked b CROSS JOIN top LEFT JOIN had USING (head)""",
    "commits_ahead": ANCESTRY + """
        SELECT sha FROM reach, top WHERE head = top AND sha NOT IN (SELECT sha FROM reach WHERE head = (SELECT min(head) FROM banked WHERE head > 0))""",
    "facts_table": sql("facts", "SELECT key, kind, " + ", ".join(f"round({f}::DOUBLE, 6) AS {f}" for f in FIELDS) + " FROM facts"),
    "rule_hits_single": sql("functions", "SELECT key, loc FROM functions WHERE loc >= 200"),
    "rule_hits_conjunction": sql("facts", "SELECT key, loc, illegible FROM facts WHERE kind = 'func' AND loc >= 200 AND illegible >= 0.6"),
    "rule_hits_null_never_matches": sql("functions", "SELECT count(*) AS hits, min(cognitive) AS least FROM functions WHERE cognitive < 100000"),
    "rule_catalog_counts": sql("only_counts", "SELECT rule, hits, alone_n AS \"only\" FROM only_counts"),
    "rule_report_top50": sql("hits", "SELECT rule, rank, key, loc::BIGINT AS loc, total FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY loc DESC, key) AS rank, count(*) OVER (PARTITION BY rule) AS total FROM hits) WHERE rank <= 50"),
    "rule_marginal_only": sql("alone", "SELECT key, rule FROM alone"),
    "distinct_subjects": sql("hits", "SELECT count(DISTINCT key) AS subjects FROM hits"),
    "field_spread": sql("facts", "SELECT kind, field, n, round(v[floor((n - 1) * 0.5)::INT + 1], 6) AS median, round(v[floor((n - 1) * 0.95)::INT + 1], 6) AS p95, round(v[n], 6) AS max FROM (" + " UNION ALL ".join(f"SELECT kind, '{f}' AS field, count({f}) AS n, list_sort(list({f}::DOUBLE) FILTER (WHERE {f} IS NOT NULL)) AS v FROM facts GROUP BY kind" for f in SPREAD) + ") WHERE n > 0"),
    "rule_calibrate": sql("calibration", "SELECT rule, round(value, 6) AS value FROM calibration"),
    "rules_overview": sql("only_counts calibration facts", "SELECT r.rule, coalesce(hits, 0) AS hits, coalesce(alone_n, 0) AS \"only\", (SELECT count(*) FROM facts f WHERE f.kind = r.kind) AS population, round(value, 6) AS suggestion FROM (VALUES " + ", ".join(f"('{i}', '{p}')" for i, (p, *_) in SHIPPED.items()) + ") r(rule, kind) LEFT JOIN only_counts USING (rule) LEFT JOIN calibration USING (rule)"),
    "decision_live_hits": sql("shown", "SELECT key, loc FROM shown WHERE NOT hidden"),
    "decision_settled": sql("shown", "SELECT 'ad-hoc' AS rule, count(*) AS settled FROM shown WHERE hidden"),
    "verdict_counts": sql("decided", "SELECT 'ad-hoc' AS rule, count(*) FILTER (WHERE verdict = 'false-positive') AS false_positive, count(*) FILTER (WHERE verdict = 'fine-always') AS fine_always FROM decided WHERE known"),
    "rule_blocked": "SELECT * FROM (VALUES ('r1', 'nothing to compare'), ('r2', 'nothing to compare'), ('r3', 'nothing to compare')) t(rule, need)",
    "merge_findings": sql("hits", "SELECT key, string_agg(rule, ',' ORDER BY rule) AS rules, count(*) AS n FROM hits GROUP BY key"),
    "tree_rollup": sql("under", "SELECT node AS path, CASE WHEN node = path THEN 'file' ELSE 'dir' END AS kind, sum(loc)::BIGINT AS loc, sum(ncloc)::BIGINT AS ncloc, count(*) AS funcs, sum(cognitive)::BIGINT AS cognitive, round(sum(w * surprise) / sum(w), 6) AS surprise, round(sum(w * documented) / sum(w), 6) AS documented, round(sum(w * churn) / sum(w), 6) AS churn, round(max(age), 6) AS age, round(min(touched), 6) AS touched, sum(callers)::BIGINT AS callers, sum(calls)::BIGINT AS calls FROM under GROUP BY 1, 2"),
    "tree_rollup_hot_share": sql("sized", """
        , f AS (SELECT path, d2, d1, sum(loc) AS loc, sum(w * tangle) / sum(w) FILTER (WHERE tangle IS NOT NULL) AS t, sum(w) AS w, sum(CASE WHEN read THEN w ELSE 0 END) AS a, sum(CASE WHEN read AND surprise > 0.5 THEN w ELSE 0 END) AS h FROM sized GROUP BY ALL),
        g AS (SELECT d2 AS path, d1, sum(loc) AS loc, sum(greatest(loc, 1) * t) / sum(greatest(loc, 1)) FILTER (WHERE t IS NOT NULL) AS t, sum(w) AS w, sum(a) AS a, sum(h) AS h FROM f GROUP BY ALL),
        k AS (SELECT d1 AS path, sum(loc) AS loc, sum(greatest(loc, 1) * t) / sum(greatest(loc, 1)) FILTER (WHERE t IS NOT NULL) AS t, sum(w) AS w, sum(a) AS a, sum(h) AS h FROM g GROUP BY ALL),
        r AS (SELECT '' AS path, sum(loc) AS loc, sum(greatest(loc, 1) * t) / sum(greatest(loc, 1)) FILTER (WHERE t IS NOT NULL) AS t, sum(w) AS w, sum(a) AS a, sum(h) AS h FROM k)
        SELECT path, round(a / w, 6) AS analysed_share, round(CASE WHEN a > 0 THEN h / a END, 6) AS hot_share, round(t, 6) AS tangle
        FROM (SELECT path, t, w, a, h FROM f UNION ALL SELECT path, t, w, a, h FROM g UNION ALL SELECT path, t, w, a, h FROM k UNION ALL SELECT path, t, w, a, h FROM r)"""),
    "container_shares": sql("under", "SELECT node AS dir, round(count(*) FILTER (WHERE callers > 0) / count(callers), 6) AS called, round(count(*) FILTER (WHERE calls > 0) / count(calls), 6) AS reaching, round(count(*) FILTER (WHERE NOT has_doc) / count(*), 6) AS undocumented, round(sum(CASE WHEN surprise > 0.5 THEN loc END) / sum(loc), 6) AS opaque FROM under GROUP BY node"),
    "lens_histogram": sql("sized", f"SELECT {lens('callers', [(0, 'none'), (1, 'one'), (2, 'few'), (6, 'many')])} AS bucket, count(*) AS functions, sum(loc)::BIGINT AS lines, round(avg(churn), 6) AS mean_ramp FROM sized GROUP BY 1"),
    "tree_histogram_by_dir": sql("under", f"SELECT node AS dir, {lens('tangle', [(0, 'plain'), (0.05, 'mild'), (0.4, 'knotty'), (0.75, 'tangled')])} AS bucket, count(*) AS functions, sum(loc)::BIGINT AS lines, round(avg(tangle), 6) AS mean_ramp FROM under WHERE node <> path GROUP BY 1, 2"),
    "band_medians": sql("medians", "SELECT band, members, median FROM medians"),
    "tangle_ramp": sql("tangled", "SELECT key, round(CASE WHEN median IS NULL THEN raw ELSE tangle END, 6) AS weighted, round(raw, 6) AS raw, round(times, 6) AS times FROM (SELECT key, median, CASE WHEN cognitive IS NULL THEN NULL ELSE raw END AS raw, CASE WHEN cognitive IS NULL THEN NULL ELSE tangle END AS tangle, times FROM tangled)"),
    "subject_keys": sql("functions", "SELECT key, ord, path, func_id AS start_line FROM functions"),
    "path_history": sql("touches", "SELECT path, count(*) AS commits, count(*) FILTER (WHERE ts >= NOW - INTERVAL 90 DAY) AS recent, min(ts) AS oldest, max(ts) AS newest, arg_max(author, (ts, -sha)) AS last_author, arg_max(sha, (ts, -sha)) AS last_commit FROM touches GROUP BY path"),
    "history_merge_incremental": sql("touches", "SELECT path, count(*) AS commits, count(*) FILTER (WHERE ts >= NOW - INTERVAL 90 DAY) AS recent, min(ts) AS oldest, max(ts) AS newest, arg_max(author, (ts, -sha)) AS last_author, arg_max(sha, (ts, -sha)) AS last_commit FROM touches GROUP BY path"),
    "dir_commit_once": sql("touches", "SELECT d AS path, count(DISTINCT sha) AS commits FROM (SELECT sha, unnest([path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1), '']) AS d FROM touches) GROUP BY d"),
    "author_rank": "SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1024",
    "blame_range": sql("lines", """
        , x AS (SELECT *, path || '#' || ((line_no - 1) // 50 * 50 + 1) AS key FROM lines),
        a AS (SELECT key, arg_max(author, (n, first)) AS main_author, count(*) AS headcount FROM (SELECT key, author, count(*) AS n, min(line_no) AS first FROM x GROUP BY ALL) GROUP BY key)
        SELECT key, count(DISTINCT commit) AS commits, arg_max(author, (ts, -line_no)) AS last_author, round(epoch(NOW - min(ts)) / 86400.0, 6) AS age, round(epoch(NOW - max(ts)) / 86400.0, 6) AS touched, any_value(main_author) AS main_author, any_value(headcount) AS headcount FROM x JOIN a USING (key) GROUP BY key"""),
    "headcount": sql("lines", f"SELECT path, headcount, main_author FROM ({MAIN})"),
    "contributors": sql("lines", "SELECT path, author, count(*) AS lines FROM lines GROUP BY ALL"),
    "edit_windows": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE date_diff('day', ts::DATE, DATE '2024-01-31') < {d}) AS w{k}" for k, d in enumerate((4, 9, 14, 29))) + " FROM events GROUP BY user_id",
    "churn_rate": "SELECT user_id, " + ", ".join(f"round(least(count(*) FILTER (WHERE date_diff('day', ts::DATE, DATE '2024-01-31') < {d}) / greatest(8 * {d} / 90.0, 1)::DOUBLE, 1), 6) AS r{k}" for k, d in enumerate((4, 9, 14, 29))) + " FROM events GROUP BY user_id",
    "young_repo_windows": "SELECT span, CASE WHEN span >= 180 THEN 30 ELSE greatest(1, span * 30 // 180) END AS w0, CASE WHEN span >= 180 THEN 60 ELSE greatest(1, span * 60 // 180) END AS w1, CASE WHEN span >= 180 THEN 90 ELSE greatest(1, span * 90 // 180) END AS w2, least(180, greatest(1, span)) AS w3 FROM (SELECT unnest([0, 1, 29, 90, 179, 180, 4000]) AS span)",
    "as_of_frame": sql("state", "SELECT * FROM state"),
    "timeline_fold_base": sql("state", "SELECT * FROM state"),
    "as_of_live_dirs": sql("state", "SELECT d AS dir, count(DISTINCT path) AS files, count(*) AS functions, sum(loc)::BIGINT AS lines FROM (SELECT *, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS d FROM state) GROUP BY d"),
    "replay_churn_ring": sql("deltas", "SELECT l_suppkey::VARCHAR AS func_id, " + ", ".join(f"count(*) FILTER (WHERE epoch(NOW - ts) / 86400.0 <= {d}) AS d{d}" for d in (100, 400, 800, 1600)) + " FROM (SELECT DISTINCT l_suppkey, idx, ts, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY idx DESC) AS k FROM deltas WHERE idx <= 9000) WHERE k <= 16 GROUP BY 1"),
    "born_at": sql("deltas", "SELECT func_id, max(idx) AS born FROM (SELECT func_id, idx, op, lag(op) OVER (PARTITION BY func_id ORDER BY idx) AS before FROM deltas WHERE idx <= 9000) WHERE op = 'set' AND before IS DISTINCT FROM 'set' GROUP BY func_id"),
    "replay_statistics": sql("deltas", """
        , s AS (SELECT *, (op = 'set')::INT - coalesce(lag((op = 'set')::INT) OVER (PARTITION BY func_id ORDER BY idx), 0) AS step, row_number() OVER (PARTITION BY func_id ORDER BY idx DESC) AS back FROM deltas),
        c AS (SELECT idx, sum(sum(step)) OVER (ORDER BY idx) AS alive FROM s GROUP BY idx)
        SELECT count(DISTINCT func_id) AS ever, count(*) FILTER (WHERE back = 1 AND op = 'set') AS alive, (sum(loc) FILTER (WHERE back = 1 AND op = 'set'))::BIGINT AS lines, (SELECT max(alive) FROM c)::BIGINT AS peak FROM s"""),
    "busiest_commits": sql("deltas", "SELECT idx, count(*) AS changes FROM deltas GROUP BY idx ORDER BY 2 DESC, 1 LIMIT 8"),
    "commit_deltas": sql("state older", "SELECT coalesce(s.func_id, o.func_id) AS func_id, CASE WHEN s.func_id IS NULL THEN 'del' ELSE 'set' END AS op, s.path, s.loc FROM state s FULL JOIN older o ON s.func_id = o.func_id WHERE s.func_id IS NULL OR o.func_id IS NULL OR s.loc <> o.loc"),
    "edges_distinct": sql("edges", "SELECT * FROM edges"),
    "degrees": sql("degs", "SELECT * FROM degs"),
    "under_test_reachability": sql("tested", "SELECT * FROM tested"),
    "neighbour_locality": sql("nodes edges", """
        , b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
        c AS (SELECT b.src AS node, count(*) AS incident, count(*) FILTER (WHERE x.dir <> y.dir) AS away FROM b JOIN nodes x ON x.node = b.src JOIN nodes y ON y.node = b.dst GROUP BY 1)
        SELECT node, coalesce(incident, 0) AS incident, coalesce(away, 0) AS away, round(away / incident, 6) AS gap FROM nodes LEFT JOIN c USING (node)"""),
    "caller_listing": sql("nodes edges", "SELECT n.dir AS path, bool_or(n.dir = (SELECT dir FROM nodes WHERE node = 1)) AS here, count(*) AS callers FROM edges JOIN nodes n ON n.node = src WHERE dst = 1 GROUP BY 1"),
    "call_resolution_tiers": sql("resolved", "SELECT * FROM resolved"),
    "call_resolution_counts": sql("calls_ resolved", "SELECT (SELECT count(DISTINCT (caller, call_id)) FROM resolved) AS resolved, (SELECT count(*) FROM calls_) - (SELECT count(DISTINCT (caller, call_id)) FROM resolved) AS unresolved"),
    "clone_groups": r"""
        WITH s AS (SELECT doc_id AS key, lang, md5(regexp_replace(regexp_replace(text, '[A-Za-z]+', '#', 'g'), '[0-9]+', '$', 'g')) AS shape FROM documents WHERE length(text) >= 40),
        g AS (SELECT *, count(*) OVER (PARTITION BY lang, shape) AS clone_count, min(key) OVER (PARTITION BY lang, shape) AS first FROM s)
        SELECT key, dense_rank() OVER (ORDER BY first) AS clone_group, clone_count FROM g WHERE clone_count > 1""",
    "jaccard_shingles": r"""
        WITH t AS (SELECT conv_id, turn, regexp_extract_all(min(text), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS w FROM conversations GROUP BY ALL),
        g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS b FROM t),
        o AS (SELECT conv_id, turn, b, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM g),
        p AS (SELECT *, len(list_intersect(a, b)) AS k FROM o WHERE a IS NOT NULL)
        SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE k / (len(a) + len(b) - k) END, 6) AS similarity, len(a) AS n_a, len(b) AS n_b FROM p""",
    "parsed_functions": PARSED + """
        SELECT 'src/' || p_partkey AS path, lang, 'f' || p_partkey AS name, 4::BIGINT AS start_line, 3 + loc AS end_line, loc, loc - 1 AS ncloc,
               deep * (deep + 1) // 2 + CASE WHEN logic THEN deep ELSE 0 END + 1 + chain AS cognitive, (long + 2 + CASE WHEN chain > 0 THEN 1 ELSE 0 END)::INT AS calls, 'do_1' AS first_call FROM w""",
    "parsed_clones": PARSED + """,
        g AS (SELECT 'src/' || p_partkey AS key, CASE WHEN lang IN ('c', 'cpp') THEN 'c' WHEN lang IN ('javascript', 'typescript') THEN 'ts' ELSE lang END AS family, deep, long, chain FROM w),
        n AS (SELECT *, count(*) OVER s AS clone_count, min(key) OVER s AS first FROM g WINDOW s AS (PARTITION BY family, deep, long, chain))
        SELECT key, dense_rank() OVER (ORDER BY first) AS clone_group, clone_count FROM n WHERE clone_count > 1""",
    "distinctiveness": r"""
        WITH d AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source) AS own FROM documents),
        m AS (SELECT 'f' || source AS grp, doc_id, true AS asks FROM d WHERE own > 1
              UNION ALL SELECT 'd' || lang, doc_id, own = 1 FROM d WHERE lang IN (SELECT lang FROM d WHERE own = 1)),
        t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS w FROM documents),
        g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t),
        e AS (SELECT grp, doc_id, asks, len(s) AS n, unnest(s) AS gram FROM m JOIN g USING (doc_id)),
        k AS (SELECT a.grp, a.doc_id, count(*) / (a.n + b.n - count(*)) AS similarity FROM e a JOIN e b ON a.grp = b.grp AND a.gram = b.gram AND a.doc_id <> b.doc_id WHERE a.asks GROUP BY a.grp, a.doc_id, b.doc_id, a.n, b.n),
        b AS (SELECT doc_id, max(similarity) AS best FROM k GROUP BY doc_id),
        c AS (SELECT m.doc_id, CASE WHEN count(*) OVER (PARTITION BY m.grp) > 1 THEN CASE WHEN coalesce(best, 0) < 0.08 THEN 0 ELSE least(best, 0.55) END END AS closest, m.asks FROM m LEFT JOIN b USING (doc_id))
        SELECT doc_id, round(closest, 6) AS closest, round(CASE WHEN closest IS NULL OR len(s) < 8 THEN 0.5 ELSE 1 - least(greatest((closest - 0.08) / (0.55::DOUBLE - 0.08::DOUBLE), 0), 1) END, 6) AS distinctiveness
        FROM c JOIN g USING (doc_id) WHERE asks""",
    "vocabulary_novelty": sql("bodies", f", w AS (SELECT doc_id, {words('body')} AS b, {words('signature')} AS s FROM bodies) SELECT doc_id, round(CASE WHEN len(b) < 8 THEN 0.5 ELSE least(greatest((len(list_filter(b, lambda x: NOT list_contains(s, x))) / len(b) - 0.35) / (0.85::DOUBLE - 0.35::DOUBLE), 0), 1) END, 6) AS novelty FROM w"),
    "branch_density": sql("bodies", r""", w AS (SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE len(string_split(regexp_replace(body, '\n\z', ''), chr(10))) END AS lines, len(list_filter(regexp_split_to_array(body, '[^\p{L}\p{N}&|?]'), lambda x: x IN ('if', 'else', 'match', 'case', 'switch', 'for', 'while', 'loop', 'try', 'catch', 'except', '&&', '||', '?'))) AS hits FROM bodies)
        SELECT doc_id, lines, round(CASE WHEN lines < 5 THEN 0.5 ELSE least(greatest((hits / lines - 0.02) / (0.25::DOUBLE - 0.02::DOUBLE), 0), 1) END, 6) AS density FROM w"""),
    "doc_coverage": sql("bodies", f", w AS (SELECT doc_id, doc, {words('body')} AS b, {words('signature')} AS s, {words('doc')} AS d FROM bodies), o AS (SELECT doc_id, doc, list_filter(b, lambda x: NOT list_contains(s, x)) AS open, list_filter(d, lambda x: NOT list_contains(s, x)) AS d FROM w) SELECT doc_id, round(CASE WHEN doc IS NULL THEN 0 WHEN len(open) = 0 THEN 1 ELSE least(len(list_intersect(open, d)) / len(open) / 0.4::DOUBLE, 1) END, 6) AS coverage FROM o"),
    "decision_reopens": "SELECT 'd' || doc_id AS key FROM documents WHERE n_chars >= 200 AND NOT (doc_id % 2 = 0 AND doc_id % 5 <> 0)",
    "body_pins": r"SELECT doc_id, substr(sha256(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')), 1, 12) AS pin FROM documents",
    "readings_tally": tally(""),
    "tally_by_model": tally("model"),
    "tally_grouping_sets": sql("graded", "SELECT 'model' AS by, model AS value, count(*) AS readings, count(*) FILTER (WHERE trap) AS traps FROM graded GROUP BY model UNION ALL SELECT 'position', position::VARCHAR, count(*), count(*) FILTER (WHERE trap) FROM graded GROUP BY position"),
    "reading_pack_roundtrip": sql("graded", "SELECT reading_id, coalesce(MAP {'none': 1, 'some': 2, 'most': 3, 'full': 4}[predicted], 0) + 8 * coalesce(MAP {'none': 1, 'some': 2, 'most': 3, 'full': 4}[documented], 0) + 64 * coalesce(MAP {'none': 1, 'some': 2, 'most': 3, 'full': 4}[legible], 0) + 512 * trap::INT + 1024 * (1 + derivable::INT) AS packed, predicted, documented, legible, trap, derivable FROM graded"),
    "effective_grades": sql("graded", """
        , e AS (SELECT reading_id, CASE WHEN reading_id % 3 <> 0 THEN predicted WHEN surprised THEN 'none' ELSE 'full' END AS p, CASE WHEN derivable THEN 'none' ELSE documented END AS d FROM graded)
        SELECT reading_id, MAP {'full': 0.08, 'most': 0.3, 'some': 0.62, 'none': 0.92}[p] AS surprise, MAP {'full': 0.95, 'most': 0.7, 'some': 0.35, 'none': 0.0}[d] AS doc, MAP {'full': 0.05, 'most': 0.3, 'some': 0.65, 'none': 1.0}[d] AS gap FROM e"""),
    "stale_readings": "SELECT doc_id, (strlen(text) > 32000 AND doc_id % 2 <> 0) OR doc_id % 10 = 5 AS stale FROM documents JOIN labels USING (doc_id)",
    "verify_outstanding": sql("subjects reads", "SELECT id, CASE WHEN reading_id IS NULL THEN 'unread' ELSE 'stale' END AS why FROM subjects LEFT JOIN reads ON reading_id = id WHERE reading_id IS NULL OR stale"),
    "verify_summary": sql("subjects reads", "SELECT count(*) AS subjects, count(*) FILTER (WHERE reading_id IS NULL) AS unread, count(*) FILTER (WHERE stale) AS stale, count(DISTINCT CASE WHEN NOT stale THEN model END) AS instruments, CASE WHEN count(*) FILTER (WHERE reading_id IS NULL OR stale) > 0 THEN 1 WHEN count(DISTINCT CASE WHEN NOT stale THEN model END) > 1 THEN 2 ELSE 0 END AS exit_code FROM subjects LEFT JOIN reads ON reading_id = id"),
    "queue_round_robin": sql("subjects reads", """
        , q AS (SELECT id, path, round(n_chars % 97 / 97.0::DOUBLE + CASE WHEN stale THEN 2 WHEN id % 7 = 0 THEN 1 ELSE 0 END, 6) AS priority FROM subjects LEFT JOIN reads ON reading_id = id WHERE reading_id IS NULL OR stale),
        r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority DESC, id) AS turn, max(priority) OVER (PARTITION BY path) AS best, first_value(id) OVER (PARTITION BY path ORDER BY priority DESC, id) AS first FROM q)
        SELECT id, path, priority, turn, row_number() OVER (ORDER BY turn, best DESC, first) AS place FROM r ORDER BY place LIMIT 60"""),
    "reading_curve": "SELECT doc_id // 10 AS batch, max(doc_id) + 1 AS pos, (sum(sum(n_chars)) OVER (ORDER BY doc_id // 10))::BIGINT AS cumulative FROM documents GROUP BY doc_id // 10",
    "peer_window": sql("subjects", ", s AS (SELECT id, path, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY n_chars, id) AS p FROM subjects) SELECT id, path, greatest(1, least(p - 10, n - 20)) AS from_place, least(n, greatest(1, least(p - 10, n - 20)) + 20) AS to_place, n - 1 - (least(n, greatest(1, least(p - 10, n - 20)) + 20) - greatest(1, least(p - 10, n - 20))) AS omitted FROM s"),
    "search_rank": sql("functions", """
        , n AS (SELECT 'func' AS kind, name, path, func_id AS line, loc, 2 AS k FROM functions UNION ALL SELECT 'file', split_part(path, '/', 3), path, 0, 1, 1 FROM files),
        t AS (SELECT *, k + CASE WHEN lower(name) = 'supplier#000000001' THEN 30 WHEN starts_with(lower(name), 'supplier#000000001') THEN 20 WHEN contains(lower(name), 'supplier#000000001') THEN 10 WHEN contains(lower(path), 'supplier#000000001') THEN 0 END AS tier FROM n)
        SELECT kind, name, path, line, loc, tier FROM t WHERE tier IS NOT NULL ORDER BY tier DESC, loc DESC, path, line, name LIMIT 40"""),
    "kind_classification": r"""
        WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '\.html$', '.h') AS path FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(path, '^m\..*/en$') THEN 'generated' WHEN starts_with(path, 'www.') THEN 'vendored' WHEN page_id % 9 = 0 THEN 'generated' WHEN path LIKE '%.h' THEN 'header' END AS kind,
               CASE WHEN regexp_matches(path, '^m\..*/en$') OR starts_with(path, 'www.') OR page_id % 9 = 0 THEN 'contract' WHEN path LIKE '%.h' THEN 'convention' END AS how FROM p""",
    "exclusion_reasons": "SELECT CASE WHEN page_id % 13 = 0 THEN 'excluded' WHEN page_id % 5 = 1 THEN 'vendored' WHEN page_id % 5 = 3 OR page_id % 3 = 2 THEN 'generated' WHEN page_id % 5 = 2 OR page_id % 3 = 1 THEN 'test' END AS reason, count(*) AS files FROM pages GROUP BY 1",
    "category_cap": "WITH s AS (SELECT source, sum(n_chars) AS lines, count(*) AS n, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS p FROM documents GROUP BY source) SELECT CASE WHEN p <= 8 THEN source ELSE 'other' END AS category, least(p, 9) AS place, sum(lines)::BIGINT AS lines, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2",
    "legend_order": "WITH s AS (SELECT lang, sum(n_chars) AS lines, count(*) AS n, row_number() OVER (ORDER BY sum(n_chars) DESC, lang) AS p FROM documents GROUP BY lang) SELECT CASE WHEN p <= 3 THEN lang ELSE 'other' END AS category, least(p, 4) AS place, sum(lines)::BIGINT AS lines, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2",
    "top_dirs": sql("functions", "SELECT split_part(path, '/', 1) AS dir, count(*) AS functions, count(*) FILTER (WHERE is_test) AS tests FROM functions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "scan_statistics": sql("functions", "SELECT count(DISTINCT path) AS files, count(*) AS functions, sum(loc)::BIGINT AS lines, (SELECT count(*) FROM orders) AS commits, (SELECT count(DISTINCT o_custkey) FROM orders) AS authors, (SELECT round(epoch(NOW - min(o_orderdate)) / 86400.0, 6) FROM orders) AS age FROM functions"),
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL",
    "sunburst_arcs": sql("functions", """
        , f AS (SELECT path AS p3, split_part(path, '/', 1) AS p1, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS p2, sum(loc)::DOUBLE AS w FROM functions GROUP BY path),
        a AS (SELECT p1, sum(w) AS w, sum(sum(w)) OVER (ORDER BY sum(w) DESC, p1) / sum(sum(w)) OVER () AS e, sum(w) / sum(sum(w)) OVER () AS s FROM f GROUP BY p1),
        b AS (SELECT p2, p1, sum(w) AS w, sum(sum(w)) OVER (PARTITION BY p1 ORDER BY sum(w) DESC, p2) / sum(sum(w)) OVER (PARTITION BY p1) AS e, sum(w) / sum(sum(w)) OVER (PARTITION BY p1) AS s FROM f GROUP BY p2, p1),
        c AS (SELECT p3, p2, w, sum(w) OVER (PARTITION BY p2 ORDER BY w DESC, p3) / sum(w) OVER (PARTITION BY p2) AS e, w / sum(w) OVER (PARTITION BY p2) AS s FROM f),
        x AS (SELECT p1, e - s AS l, e AS r FROM a),
        y AS (SELECT p2, l + (e - s) * (r - l) AS l, l + e * (r - l) AS r FROM b JOIN x USING (p1)),
        z AS (SELECT p3, l + (e - s) * (r - l) AS l, l + e * (r - l) AS r FROM c JOIN y USING (p2))
        SELECT path, depth, round(l, 6) AS start, round(r, 6) AS "end" FROM (SELECT '' AS path, 0 AS depth, 0.0::DOUBLE AS l, 1.0::DOUBLE AS r UNION ALL SELECT p1, 1, l, r FROM x UNION ALL SELECT p2, 2, l, r FROM y UNION ALL SELECT p3, 3, l, r FROM z)"""),
    "rim_slices": sql("files", """
        , s AS (SELECT file_id AS i, (file_id * 37 % 11)::DOUBLE AS width, path AS label FROM files),
        r AS (SELECT *, sum(CASE WHEN width >= 6 OR coalesce(before, 6) >= 6 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS run FROM (SELECT *, lag(width) OVER (ORDER BY i) AS before FROM s))
        SELECT min(i) AS "at", sum(width) AS width, CASE WHEN count(*) = 1 OR max(width) * 2 > sum(width) THEN arg_max(label, (width, -i)) ELSE count(*) || ' others' END AS label, count(*) AS n FROM r GROUP BY run"""),
    "crowd_rows": sql("functions", "SELECT path, CASE WHEN loc < (SELECT sum(loc) FROM functions) / 64000.0 THEN 'rest' ELSE key END AS name, sum(loc)::BIGINT AS loc, count(*) AS members FROM functions GROUP BY 1, 2"),
    "log_page": sql("touches", "SELECT sha, sha AS seq, ts, author FROM (SELECT DISTINCT sha, ts, author FROM touches WHERE starts_with(path, 'ASIA/')) ORDER BY ts DESC, sha LIMIT 15 OFFSET 20"),
    "hottest_functions": sql("sized", "SELECT key, surprise, loc FROM sized ORDER BY surprise DESC, loc DESC, key LIMIT 25"),
    "scope_languages": "SELECT lang, count(*) AS files FROM documents WHERE doc_id % 3 = 1 GROUP BY lang",
    "rule_mentions": sql("hits", "SELECT DISTINCT rule, 100 + length(rule) AS place FROM hits"),
    "cache_prune": sql("touches files", "SELECT path, count(*) AS entries FROM touches JOIN files USING (path) WHERE file_id % 3 <> 0 GROUP BY path"),
    "retested_nodes": sql("nodes", "SELECT node, CASE WHEN node % 3 = 0 AND node % 4 <> 0 THEN node % 2 = 0 ELSE is_test END AS is_test, CASE WHEN node % 4 = 0 THEN 'contract' WHEN node % 3 = 0 THEN 'reading' WHEN is_test IS NOT NULL THEN 'convention' END AS how FROM nodes"),
    "contents_once": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "line_spans": "SELECT l_orderkey, l_linenumber, greatest(l_suppkey % 9 - l_linenumber + 1, 0)::BIGINT AS loc FROM lineitem",
    # the text between the comments is counted line by line, the rest is known
    "bare_lines": r"SELECT doc_id, (len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^[ \t\r\f\v]*$') AND NOT regexp_matches(l, '^[ \t\r\f\v]*(#|//)'))) + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END)::BIGINT AS ncloc FROM documents",
    "age_ramps": sql("", "SELECT o_orderkey, round(CASE WHEN span < 1 THEN 1 ELSE least(greatest(1 - log10(d + 1) / log10(span + 1), 0), 1) END, 6) AS ramp FROM (SELECT o_orderkey, greatest(epoch(NOW) - epoch(o_orderdate::TIMESTAMP), 0) / 86400.0::DOUBLE AS d, (o_orderkey % 4000)::DOUBLE AS span FROM orders)"),
    "share_ramps": "SELECT s_suppkey, round(CASE WHEN s_suppkey % 40 >= 25 THEN 1 ELSE pow((s_suppkey % 40) / 25.0::DOUBLE, 0.7) END, 6) AS ramp FROM supplier",
    "spelled_numbers": "SELECT p_partkey, CASE WHEN p_partkey * 7 >= 3650 THEN round(p_partkey * 7 / 365.0::DOUBLE)::BIGINT::VARCHAR ELSE printf('%.1f', p_partkey * 7 / 365.0::DOUBLE) END AS years, format('{:,}', p_partkey::BIGINT * 1000) || ['', '.25', '.50', '.75'][p_partkey % 4 + 1] AS number FROM part",
    "dated_readings": "SELECT doc_id, doc_id % 7 = 0 OR doc_id % 5 < 2 AS legible, doc_id % 7 = 0 OR doc_id % 5 < 3 AS trap FROM labels",
    "testness_by_convention": """
        SELECT page_id, CASE l WHEN 0 THEN page_id % 5 = 0 OR s = 1 WHEN 1 THEN s = 3 WHEN 2 THEN s <> 0 WHEN 3 THEN s = 1 OR s = 3 WHEN 4 THEN s = 3 ELSE CASE WHEN s = 2 OR page_id % 7 = 0 THEN true END END AS is_test,
               CASE WHEN l < 2 THEN 'contract' WHEN l < 5 OR s = 2 THEN 'convention' WHEN page_id % 7 = 0 THEN 'declared' END AS how
        FROM (SELECT page_id, page_id % 6 AS l, page_id // 6 % 4 AS s FROM pages)""",
    "call_qualifiers": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'o' || p_partkey % 9 END AS qualifier FROM part",
    "remote_slugs": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'o' || s_suppkey % 5 || '/r' || s_suppkey END AS slug FROM supplier",
    "legend_categories": sql("lines", """
        , newest AS (SELECT path, author AS newest FROM lines QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, line_no) = 1),
        pile AS (SELECT path, author AS pile FROM lines GROUP BY path, author QUALIFY row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, min(line_no) DESC) = 1)
        SELECT * FROM newest JOIN pile USING (path)"""),
    "trace_estimate": "SELECT 1.0::DOUBLE AS log, round(b, 6) AS blame, round(e, 6) AS edits, round(1 + b + e, 6) AS total, 1 + b + e <= 10 AS affordable FROM (SELECT (SELECT count(*) FROM supplier) * 0.034::DOUBLE AS b, (SELECT count(*) FROM orders) * 0.01::DOUBLE AS e)",
    "lens_open": sql("functions", "SELECT unnest(['tangle', 'tests', 'blank']) AS lens, unnest([bool_or(cognitive IS NOT NULL), bool_or(is_test IS NOT NULL), false]) AS open FROM functions"),
    "resync_file": sql("functions", """
        SELECT path, func_id, func_id + CASE WHEN first THEN 10 ELSE 0 END AS start_line, loc + CASE WHEN first THEN 1 ELSE 0 END AS loc, CASE WHEN first THEN 'new' ELSE 'old' END AS body_hash
        FROM (SELECT *, path = (SELECT min(path) FROM functions) AS first FROM functions) WHERE NOT (first AND func_id % 3 = 0)"""),
    "language_families": "SELECT lang, CASE WHEN k < 2 THEN 'c' WHEN k < 5 THEN 'ts' ELSE lang END AS family, count(*) AS n FROM (SELECT p_partkey % 7 AS k, ['c', 'cpp', 'tsx', 'javascript', 'typescript', 'python', 'go'][p_partkey % 7 + 1] AS lang FROM part) GROUP BY ALL",
    "age_fallback": sql("functions", """
        SELECT key, CASE WHEN own THEN func_id WHEN file_id % 2 = 1 AND file_id % 5 <> 0 THEN file_id END::DOUBLE AS age, CASE WHEN own THEN func_id / 2.0::DOUBLE WHEN file_id % 2 = 1 AND file_id % 5 <> 0 THEN file_id / 4.0::DOUBLE END AS touched
        FROM (SELECT *, file_id % 2 = 0 AND func_id % 3 <> 0 AS own FROM functions)"""),
    "recent_replaced": sql("touches files", "SELECT path, count(*) AS commits, any_value(CASE WHEN file_id % 3 <> 0 THEN file_id ELSE 0 END)::BIGINT AS recent FROM touches JOIN files USING (path) GROUP BY path"),
    "invalid_reports": "SELECT doc_id, CASE WHEN toxic = 1 AND doc_id % 4 IN (1, 3) THEN 'trap without a note' ELSE 'tool syntax in the note' END AS why FROM labels WHERE toxic = 1 AND doc_id % 4 IN (1, 3) OR doc_id % 4 = 2",
    "unparsed_files": sql("files", "SELECT dir AS path, count(*) AS files, count(*) FILTER (WHERE file_id % 4 = 0) AS unparsed FROM files GROUP BY dir"),
    "scope_inherited": sql("functions", "SELECT key, loc FROM functions WHERE file_id % 9 <> 0 AND split_part(path, '/', 1) <> 'ASIA'"),
    "functions_of_files": sql("functions", "SELECT key, loc, cognitive FROM functions WHERE file_id % 4 = 1"),
    # the longest directory that is above all files of a commit
    "common_dirs": sql("touches", """
        , up AS (SELECT sha, path, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir FROM touches)
        SELECT sha, arg_max(dir, length(dir)) AS dir FROM (SELECT sha, dir, count(DISTINCT path) AS n FROM up GROUP BY ALL) JOIN (SELECT sha, count(DISTINCT path) AS n FROM touches GROUP BY ALL) USING (sha, n) GROUP BY sha"""),
    "replay_rollup": sql("functions touches", """
        , f AS (SELECT path, l, n, c FROM (SELECT path, sum(loc) AS l, count(*) AS n FROM functions GROUP BY path) JOIN (SELECT path, count(*) AS c FROM touches GROUP BY path) USING (path))
        SELECT dir AS path, sum(l)::BIGINT AS loc, sum(n)::BIGINT AS funcs, max(c) AS commits FROM (SELECT *, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir FROM f) GROUP BY dir"""),
}
