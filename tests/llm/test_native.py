"""Exact dedup, mixing, line dedup and license scans against brute force."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from vistaq.llm import exact_dedup, licenses, line_dedup, mixing, near_dedup
from vistaq.llm.common import Workspace

from .fixtures import SCHEMA, as_set, awkward, frame


def largest(ids):
    return max(ids, key=lambda x: (x is not None, x or 0))


def test_exact_groups(spark):
    rows = awkward()
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    want = sorted(((i, largest(by[t or ""]), len(by[t or ""]), i == largest(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr)
    got = exact_dedup.exact_groups(frame(spark, rows, True), Workspace(spark, "t"))
    assert as_set(got) == want


def test_texts_of_one_digest_stay_apart(spark):
    rows = awkward()
    good = as_set(exact_dedup.exact_groups(frame(spark, rows), Workspace(spark, "t")))
    weak = exact_dedup.exact_groups(frame(spark, rows), Workspace(spark, "t"), digest=lambda t: F.length(t).cast("string"))
    assert as_set(weak) == good


def test_drop_exact_duplicates(spark):
    rows = awkward()
    kept = exact_dedup.drop_exact_duplicates(frame(spark, rows, True))
    assert kept.columns == frame(spark, rows, True).columns
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    got = kept.collect()
    assert sorted((r.text or "" for r in got)) == sorted(by)
    assert all(r.doc_id == largest(by[r.text or ""]) and r.score == "score" for r in got)
    assert exact_dedup.drop_exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.exact_groups(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_rows_with_columns_that_have_no_order(spark):
    rows = [(1, "a", {"k": 1}), (1, "a", {"k": 2}), (1, "a", None), (2, "b", {"x": 1}), (None, None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "", str(r.extra)) for r in kept.collect()) == [(0, "", "{}"), (1, "a", "{'k': 2}"), (2, "b", "{'x': 1}")]
    near = near_dedup.drop_near_duplicates(docs, Workspace(spark, "t"))
    assert sorted((r.doc_id or 0, r.text or "", str(r.extra)) for r in near.collect()) == [(0, "", "{}"), (1, "a", "{'k': 2}"), (2, "b", "{'x': 1}")]
    bare = docs.select("doc_id", "text")
    assert exact_dedup.drop_exact_duplicates(bare).count() == 3


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_mixing(spark):
    rows = awkward()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(dict(sizes))
    got = mixing.mix_counts(frame(spark, rows), Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r._size == size(r.text)
        rate = min(3, r.target / r.source_size) if r.source_size else 0
        assert int(rate) <= r._copies <= min(3, int(rate) + 1)
    copies = {(r.doc_id, r.text): r._copies for r in got}
    mixed = mixing.mix(frame(spark, rows, True), Workspace(spark, "t"))
    assert mixed.columns == frame(spark, rows, True).columns
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[r.doc_id, r.text] += 1
    times = defaultdict(int)
    for r in rows:
        times[r[0], r[1]] += 1
    assert {k: copies[k] * n for k, n in times.items() if copies[k]} == dict(seen)
    assert mixing.mix(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ("a", "b", "c", "d")[i % 4 if i % 10 else 0], 0) for i in range(6000)]
    got = mixing.mix_counts(frame(spark, rows), Workspace(spark, "t")).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in got.collect())


def brute_lines(rows, min_docs=10, min_chars=1):
    """Each row is a document, rows that repeat too."""
    rows = [tuple([*r]) for r in rows]
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            docs[key(line)].add(id(r))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(docs[key(x)]) < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = awkward()
    got = line_dedup.drop_lines(frame(spark, rows, True), Workspace(spark, "t"))
    assert as_set(got.select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute_lines(rows)
    assert sum(r[2] for r in brute_lines(rows)) > 30
    low = line_dedup.drop_lines(frame(spark, rows), Workspace(spark, "t"), min_docs=2, min_chars=0)
    assert as_set(low.select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute_lines(rows, 2, 0)
    assert line_dedup.drop_lines(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_rows_that_repeat_are_documents(spark, tmp_path):
    import duckdb

    rows = [(None, "null ids\nten of them", "en", "s", 0)] * 10 + [(7, "nine\nlines\nnine", "en", "s", 0)] * 9 + [(8, "nine\nhalf", "en", "s", 0), (8, "half", "en", "s", 0)]
    rows += [(9, "a\nb\na", "en", "s", 0)] * 400 + [(100 + i, f"own {i}\n" + ("ten of them" if i < 3 else "x"), "en", "s", 0) for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op6_line_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert as_set(got) == sorted(con.sql(line_dedup.OP6_SQL).fetchall(), key=repr)
    lost = line_dedup.keep_bitmaps(frame(spark, rows), Workspace(spark, "t"))
    assert all(len(line_dedup.unpack_bits(r.keep)) <= 3 for r in lost.collect())
    assert lost.count() == lost.select("doc").distinct().count()


def test_a_line_in_most_documents_spreads_over_partitions(spark):
    rows = [(i, f"own {i}\nEvery document has this\n{'rare' if i < 9 else 'often'}", "en", "s", 0) for i in range(3000)]
    got = line_dedup.drop_lines(frame(spark, rows), Workspace(spark, "t"))
    assert as_set(got.select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute_lines(rows)
    first = line_dedup.drop_lines(frame(spark, rows), Workspace(spark, "t"), keep_first=True)
    assert first.agg(F.sum("n_dropped")).first()[0] == 3000 - 1 + 2991 - 1


def test_bitmaps():
    for dropped in ([0], [3, 1], list(range(0, 900, 7))):
        keep = line_dedup.unpack_bits(line_dedup.pack_bits(dropped))
        assert sorted(i for i, k in enumerate(keep) if not k) == sorted(dropped)


def brute_finds(rows):
    """All columns of scan_licenses: every window against every template, without sketches."""
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda w: [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    lists = [shingles(split(body)) for _, body in licenses.TEMPLATES]
    names, sets, steps = [a for a, _ in licenses.TEMPLATES], [set(x) for x in lists], [licenses.window_class(len(x)) for x in lists]
    family = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 2 * len(sets[i] & sets[j]) >= min(len(sets[i]), len(sets[j])):
                family = [family[j] if f == family[i] else f for f in family]
    out = []
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        s, found = shingles(split(text or "")), []
        for i, t in enumerate(sets):
            others = [t - sets[j] for j in range(len(sets)) if family[j] == family[i] and names[j] != names[i]]
            for b in range(0, len(s), steps[i]):
                window = set(s[b : b + 2 * steps[i]])
                part = len(t & window) / len(t)
                if part >= 0.8:
                    found.append((i, b, part, all(o & window for o in others if o)))
        reach = 2 * max(steps)
        marked = [(*f, f[2] == max(g[2] for g in found if family[g[0]] == family[f[0]] and abs(g[1] - f[1]) <= reach)) for f in found]
        for license in {names[f[0]] for f in marked}:
            mine = [f for f in marked if names[f[0]] == license]
            i, b, part, _, best = max(mine, key=lambda f: (f[4], f[3], f[2], -f[1], -f[0]))
            kin = sorted({n for n, g in zip(names, family, strict=True) if g == family[mine[0][0]]})
            out.append((doc_id, license, ", ".join(kin) if len(kin) > 1 else None, any(f[3] for f in mine), best, i, b, round(part, 6), len({f[1] for f in mine})))
    return sorted(out, key=repr)


def brute_licenses(rows):
    return {r[:2] for r in brute_finds(rows)}


def test_licenses(spark):
    rows = [r for r in awkward() if r[0] != 950]
    long = rows[0][1] + " "
    texts = [body for _, body in licenses.TEMPLATES] + [long + body.upper() + " " + long for _, body in licenses.TEMPLATES] + ["MIT License", "Released under the", "no license at all"]
    rows += [(5000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(6000, "word " * 300 + licenses._MIT.replace("copy ", "copies ") + " word" * 300, "en", "s", 0), (None, texts[0], None, None, None)]
    got = licenses.scan_licenses(frame(spark, rows, True)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_finds(rows) and all(r.best in (True, False) and r.containment >= 0.8 for r in got)
    best = {(r.doc_id, r.license) for r in got if r.best and r.told_apart}
    own = {(5000 + i, a) for i, (a, _) in enumerate(licenses.TEMPLATES)} | {(5000 + len(licenses.TEMPLATES) + i, a) for i, (a, _) in enumerate(licenses.TEMPLATES)}
    assert own <= best and (6000, "MIT") in best and (None, "MIT") in best
    assert not {r.doc_id for r in got} & {5000 + 2 * len(licenses.TEMPLATES) + i for i in range(1, 3)}
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_relatives_are_not_named_as_one_another(spark):
    cc = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License."
    gnu = "This work is licensed under the GNU General Public License, version {}."
    rows = [(1, cc.format("ShareAlike"), {"CC-BY-SA-4.0"}), (2, cc.format("NoDerivatives"), {"CC-BY-ND-4.0"}), (3, gnu.format(1), {"GPL-1.0"}), (4, "Licensed under CC BY-ND 4.0.", {"CC-BY-ND-4.0"}), (5, gnu.format(2), {"GPL-2.0"})]
    got = licenses.scan_licenses(frame(spark, [(i, t, "en", "s", 0) for i, t, _ in rows] + [(9, gnu.format(9), "en", "s", 0), (10, cc.format("Unheard"), "en", "s", 0)])).collect()
    assert {(r.doc_id, r.license) for r in got if r.doc_id < 9 and r.best and r.told_apart} == {(i, a) for i, _, names in rows for a in names}
    for i, name in ((9, "GPL-2.0"), (10, "CC-BY-4.0")):  # not listed: only the family is certain
        found = [r for r in got if r.doc_id == i]
        assert found and not any(r.told_apart for r in found) and all(name in r.family for r in found)


def test_templates_from_files(spark, tmp_path):
    body = "\n".join(f"{k}. Clause {k} of a license says w{k} x{k} y{k} z{k}." for k in range(900))
    (tmp_path / "Own-1.0.txt").write_text(body)
    found = licenses.template_files(spark, str(tmp_path))
    assert found == (("Own-1.0", body),)
    got = licenses.scan_licenses(frame(spark, [(1, "before " * 50 + body + " after" * 50, "en", "s", 0), (2, body[: len(body) // 2], "en", "s", 0)]), (*licenses.TEMPLATES[:9], *found)).collect()
    assert [(r.doc_id, r.license, r.family, r.best) for r in got] == [(1, "Own-1.0", None, True)]


def test_bands_reach_their_probability():
    for n in range(1, 130):
        step, k = licenses.window_class(n), licenses.bands_for(n)
        least = 0.8 * n / (2 * step + 0.2 * n)
        assert step >= n and 1 - (1 - least) ** k >= licenses.SURE


def test_schema(spark):
    assert frame(spark, []).schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
