"""Every operator on small fixtures: brute force, nulls, empty and long texts,
ties and repeated rows, empty tables, extra columns."""
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from demandlens.llm import (ann, components, cotrain, decontaminate, html_text, langid, merkle, mixing, ngram_join, pii,
                            quotes)
from demandlens.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, tx string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice([f"w{i}" for i in range(400)], n))


def table(spark, rows):
    return spark.createDataFrame([r + (None,) * (8 - len(r)) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    base = words(60, 1)
    rows = [(1, base, "en", "a", 5), (2, base + " extra", "en", "a", 5), (3, base.upper(), "fr", None, None),
            (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n ", "en", "b", 3), (7, "one two", "en", "b", 7),
            (8, "One  two", "de", "b", 7), (9, words(30000, 2), "de", "c", 1), (None, words(50, 3), "en", "c", 1),
            (10, "mail a.b@c.example.org or +1 (456) 555-2186 from 10.0.0.1, 4111 1111 1111 1111", "en", "c", 1),
            (10, "mail a.b@c.example.org or +1 (456) 555-2186 from 10.0.0.1, 4111 1111 1111 1111", "en", "c", 1),
            (11, "a" * 50000, "en", "c", 1), (12, "日本語 ñandú 😀", "es", "d", 1)]
    return table(spark, rows).cache()


def shingles_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles_of(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [j for m, (j, _) in enumerate(sets) if find(m) == find(k) and j is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return sorted(out, key=str)


def test_jaccard_join_is_brute_force(spark, odd):
    near = [(100 + k, " ".join(w for i, w in enumerate(words(80, 5).split()) if i not in (k, k + 9)), "en", "n", 1)
            for k in range(0, 40, 2)]
    docs = odd.unionByName(table(spark, near))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute_components(docs.select("doc_id", "text").collect())
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    comp = {c for _, n, c in got if n}
    assert sorted(i for i in ids if i is not None and i in comp) == sorted(i for i in comp if i is not None)


def test_jaccard_join_of_nothing(spark, odd):
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0
    assert ngram_join.one_of_each(odd.limit(0)).count() == 0


def test_sketch_bounds():
    with np.errstate(over="ignore"):
        a, b = shingle_set(words(300, 7)), shingle_set(words(290, 7) + " x y z")
        sa, sb = ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)
        m = min(len(sa), len(sb))
        apart = int(np.bitwise_count(ngram_join._fold(sa, m) ^ ngram_join._fold(sb, m)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert len(np.intersect1d(ngram_join.words_of(a), ngram_join.words_of(b))) > 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[90], got[95], got[100]} == {90}
    assert components.components(edges.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and luhn % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_pii_base_spans_are_brute_force(spark, odd):
    tricky = ["a@b.c@d.e a@b.c.%d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "ñ+1 (456) 555-2186é 4111-1111-1111-11112222",
              "a@b.c\n+123456789 " * 5, "1" * 3000 + ".1.1.1", "a." * 3000 + "@b.c"]
    docs = odd.unionByName(table(spark, [(50 + i, t) for i, t in enumerate(tricky)]))
    for r in pii.report(pii.find_pii(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = brute_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in BASE)
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_pii_contexts_find_unseen(spark):
    rng = np.random.default_rng(3)
    seeds = [(i, f"x call me at 10.1.{i}.{rng.integers(100, 250)} today y") for i in range(30)]
    docs = spark.createDataFrame(seeds + [(99, "x call me at 10.1.7.999 today y")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(pii.find_pii(docs)).collect()}
    assert spans[99] == "ip:13:23"
    text = {r.doc_id: r.text for r in pii.redact(docs, pii.find_pii(docs)).collect()}
    assert text[99] == "x call me at [ip] today y"


def test_pii_second_hop(spark):
    seeds = [f"call at 10.1.{10 + i // 100}.{100 + i % 100} today" for i in range(200)]
    unseen = [f"10.1.{30 + i}.999" for i in range(20)]               # no valid address, so no base span
    hop1 = [f"call at {w} today" for w in unseen]
    hop2 = [f"gateway {w} please" for w in [*unseen, "10.1.77.999"]]
    docs = spark.createDataFrame(list(enumerate([*seeds, *hop1, *hop2, "alone 10.1.33.999 there", "clean 10.1.88.999 text"])),
                                 "doc_id long, text string")
    found = {n: {r.doc_id: r.spans for r in pii.report(pii.find_pii(docs, rounds=n)).collect()} for n in (1, 2)}
    last = 240
    for n in found:
        assert all(found[n][i] == "ip:8:19" for i in range(200, 220))
        assert all(found[n][i] for i in range(220, 240))        # other places of what was discovered
        assert found[n][last + 1] == "ip:6:17" and found[n][last + 2] == ""
    assert found[1][last] == "" and found[2][last] == "ip:8:19"  # known through discovered seeds only


def test_pii_running_sums_and_many_matches(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        numbers = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        got = pii._with_running_sums(spark.range(1), numbers, "s")
        assert got.first().s == np.cumsum(np.arange(1, n + 1)).tolist()
    text = " ".join(f"n{i}" for i in range(20000)) + " a@b.cd" * 3
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.report(pii.find_pii(docs)).first().spans == ",".join(brute_spans(text))


def test_redact_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd now", 13, "s", "f", "n"), (2, None, None, None, None, None)],
                                 "doc_id long, text string, n_chars long, _spans string, spans string, tx string") \
        .selectExpr("*", "'q' as _f", "'q' as _new", "'q' as new", "'q' as doc", "'q' as s_tx", "'q' as d_tx")
    got = pii.redact(docs, pii.find_pii(docs))
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].text, rows[1].n_chars, rows[1]["_spans"], rows[1].spans, rows[1].tx) == ("to [email] now", 14, "s", "f", "n")
    assert (rows[2].text, rows[2].n_chars) == (None, None)


def test_mix(spark, odd):
    docs = odd.unionByName(table(spark, [(1000 + i, words(20 + i % 60, i), "en", "abcd"[i % 3], 1) for i in range(400)]))
    rows = mixing.pareto_mix(docs).select("doc.doc_id", "doc.source", "doc.text", "size", "source_size", "target", "taken").collect()
    assert len(rows) == docs.count()
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert sum(r.size for r in group) == group[0].source_size
        assert abs(sum(r.taken for r in group) - group[0].target) <= max([r.size for r in group]) / 2 + 1
    total = sum(r.size for r in rows)
    assert abs(sum(g[0].target for g in by.values()) - 1.5 * total) < 1e-6 * total
    again = mixing.pareto_mix(docs.repartition(3)).select("doc.doc_id", "taken").collect()
    assert sorted((str(r.doc_id), r.taken) for r in rows) == sorted((str(r.doc_id), r.taken) for r in again)
    assert mixing.pareto_mix(odd.limit(0)).count() == 0


def test_decontaminate_is_brute_force(spark, odd):
    items = [(1, words(20, 1)), (2, "one two"), (3, None), (4, ""), (5, words(40, 77)), (6, words(12, 2)), (6, words(12, 2))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d.doc_id, i, len(shingles_of(t)), len(shingles_of(t) & shingles_of(d.text)))
                  for d in odd.filter("doc_id is not null").collect() for i, t in items
                  if shingles_of(t) and 100 * len(shingles_of(t) & shingles_of(d.text)) >= 75 * len(shingles_of(t)))
    for block in (decontaminate.BLOCK, 10):
        hits = decontaminate.with_matches(odd, bench, block=block).filter("doc_id is not null") \
            .select("doc_id", F.explode(decontaminate.MATCHES).alias("m")).select("doc_id", "m.*").collect()
        assert sorted(map(tuple, hits)) == want
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and {1, 2, 3, 7, 8, 9}.isdisjoint(r.doc_id for r in clean.collect())
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0


def test_forward_algorithm_is_brute_force():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    rng = np.random.default_rng(0)
    p, unknown = rng.random((len(pieces), 3)) / 10, np.full(3, 1e-7)
    row = {x: i for i, x in enumerate(pieces)}

    def total(w):
        if not w:
            return np.ones(3)
        out = np.zeros(3)
        for k in range(1, len(w) + 1):
            if w[:k] in row:
                out += p[row[w[:k]]] * total(w[k:])
            elif k == 1:
                out += unknown * total(w[1:])
        return out

    with np.errstate(over="ignore"):
        got = langid.Scorer(pieces, p, unknown).scores(["abab ba", None, "12", "", "zab\nab"])
    assert np.allclose(got[0], np.log(total("▁abab")) + np.log(total("▁ba")))
    assert np.allclose(got[4], np.log(total("▁zab")) + np.log(total("▁ab")))
    assert got[1] is None and got[2] is None and got[3] is None
    with np.errstate(over="ignore"):      # an emoji is no letter, a letter beyond the basic plane is one
        assert [g is None for g in langid.Scorer(pieces, p, unknown).scores(["\U0001F600 1", "\U00020000"])] == [True, False]


def test_langid_held_out(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert got[4] == got[5] == got[6] == "und"
    assert langid.identify(odd.limit(0)).count() == 0


def test_quality(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = cotrain.with_scores(docs, labels).join(labels, "doc_id").select(f"{cotrain.SCORES}.score", "quality").collect()
    assert np.mean([(r.score >= cotrain.KEEP) == (r.quality == 1) for r in got]) > 0.95
    none = cotrain.keep_good(odd, labels.limit(0))
    assert none.count() == odd.count() and none.columns == odd.columns
    assert cotrain.with_scores(odd.limit(0), labels).count() == 0


def test_quality_with_few_bad_labels(spark):
    good = [(i, words(40, i), "en", "a", 200) for i in range(1, 900)]
    bad = [(i, "buy now " * 30, "en", "spam", 200) for i in range(900, 903)]
    docs = table(spark, good + bad)
    for lot in (900, 1800, 2700):        # other ids, other places of the three
        d = docs.withColumn("doc_id", F.col("doc_id") + lot)
        labels = d.selectExpr("doc_id", "int(source = 'a') as quality")
        model = cotrain.learn(d, labels, labelled=300, pool=100)
        assert model is not None and model["prior"] == pytest.approx(np.log(899 / 3), rel=0.4)
        scored = cotrain.with_scores(d, labels, labelled=300, pool=100).select(f"{cotrain.SCORES}.score", "source").collect()
        assert max(r.score for r in scored if r.source == "spam") < np.quantile([r.score for r in scored if r.source == "a"], 0.05)


def test_split_and_rates_by_class():
    ids, y = np.arange(4000), np.array([0, 0] + [1] * 3998)
    for lot in range(20):
        held = cotrain.split(ids + 7919 * lot, y)
        assert held[y == 0].sum() == 1 and held[y == 1].sum() == 999
    assert cotrain.class_rates(1000, 999_000, 4000) == (1.0, 3000 / 999_000)
    assert cotrain.class_rates(10 ** 6, 10 ** 6, 4000) == (0.002, 0.002)
    assert cotrain.class_rates(5000, 3000, 4000) == (0.4, 2000 / 3000)
    assert cotrain.class_rates(0, 10, 4000)[1] == 1.0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    x[300:] *= rng.uniform(0.2, 3.0, size=(300, 1))
    x[50:80] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0]), (904, [None] * 32)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    recall = []
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s[i] - sc) < 1e-9 for _, i, sc in found)
        recall.append(len({f[1] for f in found} & set(order)) / 20)
    assert np.mean(recall) >= 0.9
    tied = [f[1] for f in sorted(got[0]) if 50 <= f[1] < 80]                # ties to the smaller id
    assert tied and tied == list(range(50, 50 + len(tied)))
    assert ann.nearest(vectors.limit(0), vectors, k=3).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>x", "x"), ("<body><p>a&amp;b<p>c<ul><li>x<li>y</ul></body>", "a&b\n\nc\n\nx\n\ny"),
    ("<html><body><nav><a href=x>Home</a></nav><div class=\"ad\">Buy</div><article><h1>T</h1><p>One  two<br>three</p>"
     "<p>Four</p></article><form><p>f</p></form><footer>F</footer></body>", "T\n\nOne two three\n\nFour"),
    ("<body><div class='cookie-notice'>We</div><main><p>Body <i>x</i>y</p><div id=comments><p>nice</p></div></main>"
     "<aside>s</aside><script>var a='</p>'</script>", "Body xy"),
    ("<div>" * 3000 + "deep", "deep"), ("<a " * 5000, None),
    ("<div>" * 2000 + "x" + "</span>" * 20000, "x"), ("<svg>" * 20000 + "<p>y", "y")])
def test_main_text(page, text):
    got = html_text.main_text(page)
    assert text is None or got == text


def test_main_text_keeps_sections():
    para, links = "<p>" + "long text " * 20 + "</p>", "by <a href=x>one</a> <a href=y>two</a>"
    page = ("<body><article><h1>Title</h1><div class=entry>" + para * 5 + "</div><div class=more><p>Short para.</p></div>"
            "<dl><dt>Term</dt><dd>Sense</dd></dl><figure><img src=x><figcaption>Caption</figcaption></figure><div>" + links * 9
            + "</div><details><summary>More</summary>x</details><div><div><h2>Late</h2></div></div></article></body>")
    got = html_text.main_text(page).split("\n\n")
    assert got == ["Title"] + [("long text " * 20).strip()] * 5 + ["Short para.", "Term", "Sense", "Caption", "More", "x", "Late"]


@pytest.mark.parametrize("wrap", ["class='content has-sidebar'", "class='no-sidebar'", "class=with-menu", "id='search-results'"])
def test_main_text_of_wrapped_pages(wrap):
    para, side = "<p>" + "long text " * 20 + "</p>", "<div class=sidebar><p>Aside</p></div><div id=menu><a href=x>x</a></div>"
    text, ad = ("long text " * 20).strip(), "<div class='ad'><p>Buy</p></div>"
    for body in (f"<article><h1>T</h1>{para * 2}{ad}</article>", f"<main><h1>T</h1>{para * 2}</main>",
                 f"<h1>T</h1>{para * 2}{ad}"):
        got = html_text.main_text(f"<body>{side}<div {wrap}>{body}{side}</div>{ad}<footer>F</footer></body>")
        assert got == f"T\n\n{text}\n\n{text}"
    short = f"<body><h1>T</h1><div {wrap}>{para}</div>{side}</body>"
    assert html_text.main_text(short) == f"T\n\n{text}"


def test_main_text_without_long_comments():
    reply = "<article class=comment><p>" + "so long a reply " * 40 + "</p></article>"
    page = f"<body><article><h1>T</h1><p>Short text.</p></article><div id=comments>{reply * 5}</div></body>"
    assert html_text.main_text(page) == "T\n\nShort text."


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "z"), (1, "u", "<p>a</p>", "z"), (2, None, None, "z")],
                                  "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)]


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there friend, how are you today? I am writing about the roof."),
            (1, 1, "a", "On Monday X wrote:\n> Hello there friend, how are you\n> today?\n\nI am fine. The roof needs work soon."),
            (1, 2, "u", "> I am fine. The roof needs work soon.\n>> Hello there friend, how are you today?\nWhen will you come?"),
            (1, 3, "a", "> unknown quote with no original\nok"), (1, 4, "u", None), (None, 1, "u", "x"), (2, 0, "u", "plain")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link(m).collect()}
    assert len(got) == len(rows)
    assert (got[1, 1].reply_to, got[1, 2].reply_to, got[1, 3].reply_to) == (0, 1, None)
    assert (got[1, 2].thread, got[1, 2].depth, got[1, 3].thread) == (0, 2, 3)
    assert got[1, 1].text == "I am fine. The roof needs work soon." and got[1, 2].text == "When will you come?"
    assert got[1, 4].text == "" and got[None, 1].thread == 1
    assert quotes.link(m.limit(0)).count() == 0


def test_merkle(spark):
    rows = [(f"f{i % 3}", i, bytes([i % 251]) * (50 + i)) for i in range(300)] + [(None, 1, None)]
    rec = spark.createDataFrame(rows, "file string, pos long, record binary")
    a = merkle.manifest(rec)
    changed = F.when(
        F.col("pos") == 100, F.overlay(F.col("record"), F.lit("x").cast("binary"), F.lit(3))).otherwise(F.col("record"))
    b = merkle.manifest(rec.withColumn("record", changed))
    assert merkle.audit(a, a, leaf=512, fan=4).count() == 0
    bad = merkle.audit(a, b, leaf=512, fan=4).collect()
    assert [(r.file, r.status, r.length_a) for r in bad] == [("f1", "changed", 150)]
    gone = merkle.audit(a, b.filter("file <> 'f2'"), leaf=512, fan=4)
    assert gone.filter("status = 'missing'").count() == 100
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0
    assert merkle.audit(a.limit(0), a).filter("status = 'extra'").count() == a.count()


def test_mix_stage_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, words(20 + i, i), "a" if i % 3 else None, "old", i) for i in range(12)],
                                 "doc_id long, text string, source string, mix_size string, doc long")
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.columns == ["doc_id", "text", "source", "doc", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    rows = out.collect()
    assert rows and all(r.mix_size == 20 + r.doc_id and r.doc == r.doc_id and r.mix_taken == r.mix_size * r.mix_copies for r in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.cut(stage(spark, docs, SF), name)
        assert new.columns[:5] == docs.columns[:5] and 0.5 * before < new.count() <= docs.count()
        docs = new
    assert docs.filter("mix_copies < 1 or mix_taken > 2 * mix_size").count() == 0


def test_jaccard_join_with_shared_passages(spark):
    """Passages and copies in groups above SMALL: what a set may leave out loses no link."""
    rng = np.random.default_rng(11)
    passages = [words(60, 500 + i) for i in range(3)]
    rows = []
    for i in range(260):
        kind = i % 4
        if kind == 0:                                    # a passage in own words, of all sizes
            text = words(int(rng.integers(0, 200)), 1000 + i) + " " + passages[i % 3] + " " + words(int(rng.integers(0, 60)), 2000 + i)
        elif kind == 1:                                  # a copy with some words changed
            w = words(90 + 40 * (i % 3), 7 + i % 3).split(" ")
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = f"x{rng.integers(0, 9)}"
            text = " ".join(w)
        elif kind == 2:                                  # a copy cut short: links along a chain of sizes
            w = words(240, 31).split(" ")
            text = " ".join(w[:int(rng.integers(30, 241))])
        else:                                            # a passage and little else
            text = passages[i % 3] + " " + words(int(rng.integers(0, 25)), 3000 + i)
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_words_left_out_keep_a_common_word():
    """The bound itself: a linked pair agrees in more words than either may leave out."""
    rng = np.random.default_rng(12)
    for n in (1, 2, 5, 20, 60, 100, 174, 300, 900):
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        for gone in (0, n // 4):
            b = a[gone:]
            (ka, ma, _, sa), (kb, mb, _, sb) = ngram_join.marked_words(a), ngram_join.marked_words(b)
            common = np.intersect1d(ka, kb)
            best = 0
            for parity in (0, 1):
                shared = len(np.intersect1d(ka[ma == parity], kb[mb == parity]))
                best = max(best, shared - max(sa[parity], sb[parity]))
            assert best > 0 or len(np.intersect1d(ka[ma == 2], kb[mb == 2])) > 0
            assert len(common) > 0


def test_blocks_are_brute_force():
    rng = np.random.default_rng(13)
    rows = []
    for grp in range(4):
        base = rng.integers(0, 2 ** 64, 200, dtype=np.uint64)
        for k in range(30):
            s = np.unique(np.concatenate([base[:int(rng.integers(100, 201))], rng.integers(0, 2 ** 64, int(rng.integers(0, 60)), dtype=np.uint64)]))
            rows.append((grp, k % 2, grp * 100 + k, len(s), grp * 100 + k // 2, ngram_join.bit_sketch(s).tolist(), s))
    names = ("grp", "blk", "sid", "n", "comp", "data")
    for blocks in (1, 2):
        for i, j in ((0, 0), (0, 1), (1, 1)) if blocks == 2 else ((0, 0),):
            for groups in ((0, 1, 2, 3), (2,)):
                used = [(g, b if blocks == 2 else 0, *rest) for g, b, *rest in rows if g in groups and (blocks == 1 or b in (i, j))]
                tab = pa.table({c: [r[k] for r in used] for k, c in enumerate(names)})
                want = set()
                for x in used:
                    for y in used:
                        if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and {x[1], y[1]} == {i, j}:
                            m = min(len(r[5]) for r in used if r[0] == x[0])
                            fx, fy = (ngram_join._fold(np.array(r[5]), m).view(np.uint64) for r in (x, y))
                            apart = int(np.bitwise_count(fx ^ fy).sum())
                            if 175 * apart <= 25 * (x[3] + y[3]) and 100 * min(x[3], y[3]) >= 75 * max(x[3], y[3]):
                                want.add((x[0], x[2], y[2]))
                linked = {(x[0], x[2], y[2]) for x in used for y in used if x[0] == y[0] and x[2] < y[2] and x[4] != y[4]
                          and {x[1], y[1]} == {i, j}
                          and 100 * len(np.intersect1d(x[6], y[6])) >= 75 * len(np.union1d(x[6], y[6]))}
                assert linked and linked <= want
                key = [pa.scalar(v) for v in (0, i, j)]
                exact = tab.set_column(5, "data", pa.array([r[6].view(np.int64) for r in used], pa.list_(pa.int64())))
                for run, table_, all_ in ((ngram_join._in_blocks(False), tab, want), (ngram_join._in_blocks(True), exact, linked)):
                    forest = run(key, table_).to_pydict()
                    forest = set(zip(forest["grp"], forest["a"], forest["b"]))
                    assert forest <= all_ and {g for g, *_ in forest} == {g for g, *_ in all_}
                    parent = {}
                    find = lambda c: c if parent.get(c, c) == c else find(parent[c])
                    for _, a, b in forest:              # a forest: never joins what is joined
                        ra, rb = find(a // 100 * 100 + a % 100 // 2), find(b // 100 * 100 + b % 100 // 2)
                        assert ra != rb
                        parent[ra] = rb
                    assert all(find(a // 100 * 100 + a % 100 // 2) == find(b // 100 * 100 + b % 100 // 2) for _, a, b in all_)


def test_shards_follow_the_bands(spark, monkeypatch):
    docs = table(spark, [(i, words(10 if i < 300 else 500, i)) for i in range(330)] + [(400, None), (401, "")])
    join = ngram_join.ParityJoin(docs)
    few = join.shards()
    monkeypatch.setattr(ngram_join, "SHARD_ENTRIES", 100)
    many = join.shards()
    used = {int(b) for r in join.sets.select("n").distinct().collect() for b, _ in ngram_join.spaces(r.n)}
    for first in (few, many):
        assert {k for k in range(len(first) - 1) if first[k + 1] > first[k]} == used
    assert max(np.diff(few)) == 1 and many[-1] > 10 * few[-1]
    assert ngram_join.ParityJoin(docs.limit(0)).shards()[-1] == 0


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(i, words(30, i % 3), "x", i) for i in range(9)] + [(20, None, "y", 1), (0, words(30, 0), "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k_times string, k_tx long") \
        .selectExpr("*", "doc_id as k_id", "text as __tx", "doc_id as d_id", "'z' as d_tx", "'z' as doc")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.k_times, r.k_tx) for r in kept.collect()) == [(0, "x", 0), (1, "x", 1), (2, "x", 2), (20, "y", 1)]


def test_blocks_hold_only_sets_of_their_shard():
    texts = pa.array([words(40, i) for i in range(60)])
    batch = pa.record_batch([pa.array(range(60), pa.int64()), texts], names=["doc_id", "text"])
    sets = {ngram_join.set_id(s): s for s in (shingle_set(t, ngram_join.K) for t in texts.to_pylist())}
    marks = {sid: ngram_join.marked_words(s) for sid, s in sets.items()}
    bands = max(int(m[2].max()) for m in marks.values()) + 1
    first, seen = [40 * k for k in range(bands + 1)], {sid: 0 for sid in sets}
    for part in ngram_join._word_blocks(first)(iter([batch])):
        k, raw = part.column(0)[0].as_py(), part.column(1)[0].as_py()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, may = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n)
        m = (len(raw) - 8 - 12 * n) // 6
        low, mark = np.frombuffer(raw, np.uint32, m, 8 + 12 * n), np.frombuffer(raw, np.uint16, m, 8 + 12 * n + 4 * m)
        band = k // 40
        assert set(mark & 0xFFF) == set(range(n))
        for x, i in zip(low, mark):
            sid = int(ids[i & 0xFFF])
            keys, kinds, bands, leave = marks[sid]
            assert any(int(w) & 0xFFFFFFFF == x and 40 * band + (int(w) >> 32) % 40 == k and c == i >> 12 and b == band
                       for w, c, b in zip(keys, kinds, bands))
            assert may[i & 0xFFF] == leave[band & 1]
            seen[sid] += 1
    assert seen == {sid: len(marks[sid][0]) for sid in sets}


def test_neighbours_of_small_tables(spark):
    x = np.random.default_rng(4).normal(size=(10, 64))
    rows = [(i, x[i].tolist()) for i in range(10)] + [(3, (-2 * x[3]).tolist()), (3, (x[5] + x[6]).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id <> 3")
    got = {}
    for r in ann.nearest(vectors, asked, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    for q, near in got.items():
        want = sorted(((float(np.dot(x[q], v)), -i) for i, v in rows if i != q), reverse=True)
        assert [(n, i) for n, i, _ in sorted(near)] == [(n + 1, -i) for n, (_, i) in enumerate(want)]
        assert np.allclose([s for _, _, s in sorted(near)], [s for s, _ in want])
