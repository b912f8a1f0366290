"""Operators 11 to 13 on small fixtures: brute force, DuckDB twins, nulls, ties,
repeated rows, empty tables, extra columns, groups far above the block sizes."""
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from demandlens.llm import dag_manifest, edit_lattice, licenses, oracle, queries
from tools.check_oracle import digest, type_diff

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "benchmark")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle.ORACLE[name])
    cols, want = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(cols) and type_diff(df, con, oracle.ORACLE[name]) == {}
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]


# ---------------------------------------------------------------- op12

DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, n long, path string, digest string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree_of(level):
    """(top, [(left, right) by level] of every leaf)."""
    sides, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 16 * 16:p // 16 * 16 + 16]
            sides[i].append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
        level = [H(*level[k:k + 16]) for k in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], sides


def brute_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r, leaf_of((r[0], r[1], r[2], r[3], r[4]))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(tree_of([x[1] for x in by_source[s]]))
    if not rows:
        return []
    root, above = tree_of([t[0] for t in trees])
    out = []
    for s, (sub, sides), up in zip(sources, trees, above):
        for (r, leaf), path in zip(by_source[s], sides):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            cur = leaf_of((r[0], r[1], r[2], r[3], r[4].translate(LOWER) if changed else r[4]))
            for left, right in path + up:
                cur = H(left, cur, right)
            out.append((r[0], leaf, sub, root, H(*[a + b for a, b in path + up]), cur, cur == root))
    return out


def key(row):
    return [(v is not None, str(v)) for v in row]


@pytest.mark.parametrize("case", ["many", "single", "one_source", "empty", "lone_leaves"])
def test_manifest_equals_brute_force(spark, case):
    rng = random.Random(5)
    if case == "many":                     # a hot source of 17 runs and more, others of a few, one, sixteen, seventeen rows
        rows = [(i, "hot", "en", 1, f"Text {i}") for i in range(300)]
        rows += [(i, f"s{k}", None, None, "Ab") for k, m in ((1, 1), (2, 16), (3, 17), (4, 2)) for i in range(m)]
        rows += [(i, f"x{i:02}", "é", 3, None) for i in range(20)]
        rows += [(None, None, None, None, None), (None, None, None, None, None), (7, None, "fr", 2, ""), (7, "", "fr", 2, "É A")]
        rows += [(5, "hot", "en", 1, "Text 5")] * 40 + [(5, "hot", "de", 1, "Other")]
        rng.shuffle(rows)
    else:
        rows = {"single": [(10, None, "en", 1, "A")], "empty": [], "one_source": [(i, "a", "en", 1, "Bc") for i in range(40)],
                "lone_leaves": [(i, f"s{i}", "en", 1, "Cd") for i in range(5)]}[case]
    df = spark.createDataFrame([r + ("k", 1, "p", "d") for r in rows], DOCS).repartition(6)
    got = [tuple(r) for r in dag_manifest.audit_tampered(df).collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)
    assert dag_manifest.audit_tampered(df).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_store_is_content_addressed(spark):
    rows = [(None, "a", None, None, "same")] * 64
    keyed = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = keyed.select("doc_id", "source", dag_manifest.record_digest([F.col("text")]).alias("leaf"))
    m = dag_manifest.build(leaves, "source", ["doc_id"])
    stored = m.store.collect()
    assert len(stored) == 2 and all(H(*r["children"]) == r["digest"] for r in stored)   # four equal runs are one record
    some = dag_manifest.prove(m, m.leaves.filter("path in ('00', '3f')")).collect()
    assert len(some) == 2 and all(len(r["proof"]) == 2 for r in some)
    assert [len(r["proof"][0]["left"]) for r in sorted(some, key=lambda r: len(r["proof"][0]["left"]))] == [0, 15 * 64]


# ---------------------------------------------------------------- op13

def brute_edits(codes):
    """Least (cost, audit) by trying row after row all edits and up to two inserts."""
    best = {0: (0, "")}

    def insert(b):
        for _ in range(3):
            for q, (c, a) in list(b.items()):
                to = edit_lattice.FORCED[q]
                b[to] = min(b.get(to, (c + 2, a + "I")), (c + 2, a + "I"))
        return b

    for code in codes:
        nxt = {}
        for q, (c, a) in insert(best).items():
            steps = [(q, c + 3, a + "D")]
            if code != "-":
                extra = int(code.isupper())
                steps.append((edit_lattice.FORCED[q], c + 2 + extra, a + "R"))
                to = edit_lattice.AFTER.get((q, code.lower()))
                if to is not None:
                    steps.append((to, c + extra, a + "K"))
            for to, cc, aa in steps:
                nxt[to] = min(nxt.get(to, (cc, aa)), (cc, aa))
        best = nxt
    best = insert(best)
    return min(best[q] for q in (0, 3) if q in best)


def test_search_equals_brute_force():
    for n in range(4):
        for codes in itertools.product("suaxSUA-", repeat=n):
            assert edit_lattice.least_edits("".join(codes), 0, (0, 3)) == brute_edits(codes), codes
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("ssuuuaaaxSUAX-") for _ in range(rng.randrange(4, 40)))
        assert edit_lattice.least_edits(codes, 0, (0, 3)) == brute_edits(codes), codes


def test_joined_blocks_equal_one_search():
    rng = random.Random(3)
    for _ in range(40):
        codes = "".join(rng.choice("suuuaaxSUA-") for _ in range(30))
        parts = [edit_lattice._named(edit_lattice._between(codes[b:b + 7])) for b in range(0, 30, 7)]
        ends = [(c, a) for p, q, c, a in edit_lattice._joined(parts) if p == 0 and q in (0, 3)]
        assert min(ends) == brute_edits(codes)


CONV = "conv_id long, turn long, role string, text string, key string, pos long, audit string"
SPACE = " \t\n\x0b\x0c\r"


def brute_repair(rows, ids):
    out = []
    for cid in ids:
        own = sorted((r for r in rows if r[0] == cid), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or " ").encode(), (" " if r[3] is None else r[3]).encode()))
        seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            role, text = role if role is not None else " ", text if text is not None else " "
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            letter = role[:1] if role[:1] in tuple("sua") else "x"
            codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        initials = [(r[2] if r[2] is not None else " ")[:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = brute_edits(codes)
        state, said, at = 0, [], 0
        for e in audit:
            if e == "I":
                state = edit_lattice.FORCED[state]
                said.append({2: "user", 3: "assistant"}[state] + ":")
                continue
            r, at = own[at], at + 1
            if e == "R":
                state = edit_lattice.FORCED[state]
                said.append({2: "user", 3: "assistant"}[state] + ":" + r[3])
            elif e == "K":
                state = edit_lattice.AFTER[state, r[2][0]]
                said.append(f"{r[2]}:{r[3]}")
        out.append((cid, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
             rng.choice(["Yes.", "No!", "cut off", "x.", "  ", "", f"It is {t}.", f"It is {t}"])) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2] if t % 7 else "tool", f"Line {t % 150}." if t % 11 else "open") for t in range(400)]   # seven blocks
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (None, None, "user", "First?"), (None, 3, "assistant", "A\r\n")]
    ids = [*range(30), 99, None, 500]
    df = spark.createDataFrame([r + ("k", 1, "a") for r in rows], CONV).repartition(5)
    convs = spark.createDataFrame([(i,) for i in ids] + [(99,)], "conv_id long")
    got = [tuple(r) for r in edit_lattice.repair(convs, df).collect()]
    assert sorted(got, key=key) == sorted(brute_repair(rows, ids), key=key)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONV)
    assert edit_lattice.repair(empty, edit_lattice.damage(empty)).count() == 0


def test_damage_rule(spark):
    rows = [(c, t, "system", "One. Two! x") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    df = spark.createDataFrame([r + ("k", 1, "a") for r in rows], CONV)
    want = []
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, edit_lattice.damage(df).collect()), key=key) == sorted(want, key=key)


# ---------------------------------------------------------------- op11

def brute_scan(rows):
    """rows (doc_id, text); every alignment of every looked-up word, plainly."""
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in rows]
    weights = {w: 1 + (len(rows) // (sum(w in f for f in files) + 1)).bit_length() for w in licenses.VOCABULARY}
    least = min(max(weights[w] for p in ps for w in p.split()) for _, _, ps in licenses.TEMPLATES)
    out = []
    for (doc, _), f in zip(rows, files):
        def starts(phrase):
            p = phrase.split()
            return [i for i in range(len(f)) if f[i:i + len(p)] == p]
        base = [(i, label) for phrase, label in licenses.BASE for i in starts(phrase)]
        labels, score = {x[1] for x in base}, 0.0
        for label, text, phrases in licenses.TEMPLATES:
            words = text.split()
            total = sum(weights[w] for w in words if weights[w] >= least)
            for off in {p - q for p, w in enumerate(f) for q, v in enumerate(words) if w == v and weights[w] >= least}:
                got = sum(weights[v] for q, v in enumerate(words) if weights[v] >= least and 0 <= off + q < len(f) and f[off + q] == v)
                places = [text.split().index(p.split()[0]) if len(p.split()) == 1 else len(text[:f" {text} ".index(f" {p} ")].split()) for p in phrases]
                if 2 * got >= total and all(any(abs(i - off - q) <= licenses.SLACK for i in starts(p)) for p, q in zip(phrases, places)):
                    labels.add(label)
                    score = max(score, got / total)
        at = [x[0] for x in base]
        out.append((doc, len(f), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x[1] for x in base})),
                    ",".join(sorted(labels)), score))
    return out


def test_scan_equals_brute_force(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files")
    rows = [(1, mit), (2, mit.replace("to any person", "by Jo Doe to any person")), (3, mit.replace("documentation files", "files")),
            (4, "Released under the MIT License."), (5, "MIT  license, MIT\nlicense"), (6, "the license of MIT"),
            (7, "This work is licensed under the GNU General Public License, version 3."), (8, None), (9, ""), (10, " \t.\n"),
            (11, "CC BY-NC 4.0; cc-by cc by. All rights reserved! ALL RIGHTS RESERVED"), (12, "Kcc by ſ İ cc\x00by ccby"),
            (13, "General Public License general public license"), (4, "Released under the MIT License."), (None, "MIT License " * 300),
            (14, " ".join(f"w{i}" for i in range(20000)) + " cc by nc " + "x " * 5), (15, "all rights all rights reserved")]
    rows += [(100 + i, f"the license of this {i} is in the file and the software") for i in range(40)]
    df = spark.createDataFrame([(d, t, 1, "b", "x") for d, t in rows], "doc_id long, text string, file int, base string, tokens string")
    got = [tuple(r) for r in licenses.scan(df.repartition(3)).collect()]
    want = brute_scan(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    labels = {(r[0], r[6]) for r in want}
    assert {(1, "mit"), (2, "mit"), (3, ""), (4, "mit"), (7, "gpl,gpl-3.0"), (11, "cc-by,cc-by-nc,reserved")} <= labels


def test_scan_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_template_keeps_a_looked_up_key_word():
    for rare in range(1, 12):
        weights = {w: 1 + (i * 7 + rare) % 9 for i, w in enumerate(licenses.VOCABULARY)}
        probes = licenses.looked_up(weights)
        assert all(any(w in probes for p in ps for w in p.split()) for _, _, ps in licenses.TEMPLATES)
