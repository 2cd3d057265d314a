"""Decontamination, language, SimHash, repeats, html, toxicity and the pipeline against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from ledgersieve.llm import decontaminate, html, language, repeats, simhash, toxicity
from ledgersieve.llm.components import connected
from ledgersieve.llm.suffixes import common_prefixes, suffix_array

FOLDER = "/root/testdata/sf0.001"


def documents(spark, texts, more="hit_items string, fp string"):
    return spark.createDataFrame([(i, t, "h", "f") for i, t in enumerate(texts)], f"doc_id long, text string, {more}")


def plain_hits(text, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    found, hit, owners = words(text), set(), set()
    for item, content in items:
        w = words(content)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(found) - k + 1):
                if found[j:j + k] == w[i:i + k]:
                    hit |= set(range(j, j + k))
                    owners.add(str(item))
    return len(found), len(hit), ",".join(sorted(owners))


@pytest.mark.parametrize("part_words", [200_000, 12])
def test_hits_against_windows(spark, part_words):
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 4, 5, 6, 9]))) for i in range(25)] + [(90, None), (91, "..."), (3, "A-b é9")]
    texts = [line(rng.randint(0, 40)) for _ in range(60)] + [None, "", "x A,B.é9 a b", items[0][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.match(documents(spark, texts), benchmark, window=4, part_words=part_words).collect()
    for r in got:
        n_hit = sum(e - s for s, e in zip(r.hit_starts, r.hit_ends, strict=True))
        assert (r.n_words, n_hit, ",".join(r.hit_items)) == plain_hits(texts[r.doc_id], items, 4)


def test_spans_are_cut_and_documents_dropped(spark):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    clean = " ".join(f"word{i}" for i in range(30))
    docs = documents(spark, [f"{clean} {item.upper()}, {clean}", item, clean, None, "One two, three"])
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert got == {0: f"{clean} , {clean}", 2: clean, 3: None, 4: "One two, three"}
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == 5
    assert decontaminate.decontaminate(docs.limit(0), benchmark).columns == docs.columns


def test_language_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = language.fold(docs["doc_id"], 4) == 2
    model = language.fit(docs.filter(~held_out))
    rows = language.identified(docs.filter(held_out), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    en = next(r.text for r in docs.collect() if r.lang == "en" and len(r.text) > 1500)[:1400]
    de = next(r.text for r in docs.collect() if r.lang == "de" and len(r.text) > 1500)[:700]
    odd = language.identified(documents(spark, [None, "", "12 ...", en + " " + de, "é", en]), model)
    got = {r.doc_id: r for r in odd.collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0
    assert got[3].languages == ["en", "de"] and got[3].shares[0] == pytest.approx(2 / 3, abs=0.1)
    assert got[4].lang_pred in model.languages and got[5].languages == ["en"]
    nothing = language.identified(documents(spark, ["text"]), language.fit(docs.limit(0)))
    assert nothing.first().lang_pred == "und"
    assert [r.fp for r in language.accepted(documents(spark, [None, "", "1", en], "score string, fp string"), model).collect()] == ["f"]


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_values(seed, centres, each):
    rng = random.Random(seed)
    values = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(each):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    return np.array(sorted(values), dtype=np.uint64)


def test_tree_finds_all_links():
    bits = near_values(1, 12, 40)
    edges = [(i, j) for i in range(len(bits)) for j in range(i) if int(bits[i] ^ bits[j]).bit_count() <= 3]
    member, root = simhash.spanning_links(bits.view(np.int64))
    at = {int(v): i for i, v in enumerate(bits.view(np.int64))}
    mine = components(len(bits), [(at[int(a)], at[int(b)]) for a, b in zip(member, root, strict=True)])
    assert mine == components(len(bits), edges)


@pytest.mark.parametrize("shard_rows", [20_000, 3])
def test_shards_keep_all_links(spark, shard_rows):
    bits = near_values(2, 10, 25)
    values = [int(v) for v in bits.view(np.int64)]
    at = {v: i for i, v in enumerate(values)}
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), shard_rows=shard_rows)
    edges = [(i, j) for i in range(len(bits)) for j in range(i) if int(bits[i] ^ bits[j]).bit_count() <= 3]
    want = components(len(bits), edges)
    assert components(len(bits), [(at[r.a], at[r.b]) for r in found.collect()]) == want
    roots = {r.node: r.root for r in connected(found).collect()}
    label = [roots.get(v, v) for v in values]
    assert len(set(zip(label, want, strict=True))) == len(set(want)) == len(set(label))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in connected(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert connected(edges.limit(0)).count() == 0


def test_fingerprints_and_survivors(spark):
    texts = [None, "", " ", "A b", "a B", "x y z w", "x  y\tz w", "one two three four five six", None]
    got = {r.doc_id: r for r in simhash.components(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i].fp & (1 << 64) - 1 == want
    assert [got[i].component_id for i in range(9)] == [0, 0, 0, 3, 3, 5, 5, 7, 0]
    docs = documents(spark, texts)
    again = docs.unionByName(docs.filter("doc_id = 3")).unionByName(docs.filter("doc_id > 4").selectExpr("CAST(null AS long) doc_id", "text", "hit_items", "fp"))
    kept = simhash.keep_one(again.unionByName(spark.createDataFrame([(None, "quite other words here", "", "")] * 2, docs.schema)))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(0, None), (3, "A b"), (5, "x y z w"), (7, texts[7]), (None, "quite other words here")], key=str)


def test_suffix_arrays():
    rng = random.Random(3)
    for turn in range(400):
        n, kinds = rng.randint(0, 30), rng.randint(1, 4)
        s = [rng.randint(1, kinds) for _ in range(n)]
        s = ((s[: rng.randint(1, 4)] * 20)[:n] if turn % 3 == 0 else s) + [0]
        order = suffix_array(s)
        assert list(order) == sorted(range(len(s)), key=lambda i: s[i:])
        shared = common_prefixes(s, order)
        for i in range(len(s)):
            best = 0
            for j in range(len(s)):
                k = 0
                while i != j and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
            assert shared[i] == best


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [4 << 20, 2_000])
def test_repeats_against_all_windows(spark, piece, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcde fghé") for _ in range(n))
    sources = [text(1500) for _ in range(4)]
    texts = [None, "", "Shti " * 300, "q" * 199, "q" * 199, "ab" * 400]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            start, n = rng.randint(0, 1200), rng.choice([150, 198, 199, 200, 201, 230, 400])
            parts += [rng.choice(sources)[start:start + n], text(rng.choice([0, 1, 3, 50, 300]))]
        texts.append("".join(parts))
    near = text(2500)
    for _ in range(25):
        changed = list(near)
        for _ in range(rng.randint(0, 10)):
            changed[rng.randrange(len(changed))] = rng.choice("XYZ")
        texts.append("".join(changed))
    texts += [texts[8], texts[8]]
    monkeypatch.setattr(repeats, "PIECE", piece)
    got = {r.doc_id: r for r in repeats.deduplicated(documents(spark, texts, "copies string, k1 string")).collect()}
    for i, want in enumerate(plain_repeats(texts, 200)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert repeats.deduplicated(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("members", [1, 2, 7])
def test_repeats_of_strings_in_many_surroundings(spark, members):
    rng = random.Random(11)
    text = lambda n, of="abcde fgh": "".join(rng.choice(of) for _ in range(n))
    passage, base, line = text(700), text(900), text(60)
    texts = [text(rng.randint(0, 300), "ab") + passage[rng.choice([0, 0, 1, 90]):] + text(rng.randint(0, 300), "ab") for _ in range(30)]
    texts += [text(3, "ab") + "-" * rng.randint(150, 420) + text(2, "ab") for _ in range(30)]
    texts += [text(rng.randint(0, 150)) + line + text(rng.randint(0, 150), "xy") for _ in range(20)]
    texts += ["a" * n for n in (199, 200, 250, 251, 300)] + ["ab" * 130, "ba" * 130, passage[:200], passage[-200:], passage[1:200]]
    for _ in range(40):
        at = rng.randrange(len(base))
        texts.append(base[rng.choice([0, 0, 40]):at] + rng.choice("XYZ") + base[at + rng.choice([0, 1, 2]):rng.choice([850, 900])])
    texts += texts[:3]
    got = {r.doc_id: r for r in repeats.deduplicated(documents(spark, texts), members=members).collect()}
    for i, want in enumerate(plain_repeats(texts, 200)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_a_string_in_many_surroundings_is_not_held():
    rng = random.Random(3)
    gram, n, step = b"g" * repeats.GRAM, 20_000, 500

    def read(columns, taken):
        for at in range(0, n, step):
            taken.append(at)
            yield pa.RecordBatch.from_arrays([c[at:at + step] for c in columns], names=[f"c{i}" for i in range(len(columns))])

    number, same = np.arange(n), np.zeros(n, dtype=np.int64)
    anchors = [pa.array(same), pa.array(number), pa.array(number), pa.array(number), pa.array(same.astype(np.int32))]
    parts = [pa.array(same), pa.array(same + 168), pa.array(number), pa.array(number), pa.array((same + 168).astype(np.int32)),
             pa.array(same.astype(np.int16)), pa.array((same + 168).astype(np.int16)), pa.array([rng.randbytes(168) + gram + rng.randbytes(168) for _ in range(n)])]
    taken = []
    sent = repeats._compare(read(anchors, taken), repeats.MEMBERS)
    first = next(sent)
    assert len(taken) <= 5 and first.column("large").to_pylist() == [True] * first.num_rows
    assert first.num_rows + sum(b.num_rows for b in sent) == n
    taken = []
    dealt = repeats._repeated(read(parts, taken), repeats.MEMBERS)
    rows = [next(dealt)]
    assert len(taken) <= 5
    rows = [r for b in [*rows, *dealt] for r in b.select(["k1", "low", "high", "start"]).to_pylist()]
    assert Counter(r["k1"] for r in rows) == {i: repeats.FAN for i in range(n)} and {r["start"] for r in rows} == {None}
    assert {(r["low"], r["high"]) for r in rows} == {(0, 41), (42, 83), (84, 125), (126, 168)}


PAGES = [
    ('<html><body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>First &amp; long   paragraph of text.<p>Second one,<br>with <b>marks</b>.</article>'
     '<footer>Copyright</footer></body></html>', "Title\n\nFirst & long paragraph of text.\n\nSecond one, with marks."),
    ('<body class="has-sidebar"><div id="header">Site</div><div class="content"><h2>Heading</h2><div>A paragraph that is long enough to count as text.</div>'
     '<div>Another paragraph that is long enough, too.</div><ul><li>one<li>two</ul></div><div class="sidebar"><p>Beside the text, beside the text.</p></div>'
     '<div class="comments"><p>Great article, really great article it is.</p></div><form><p>Sign here</p></form></body>',
     "Heading\n\nA paragraph that is long enough to count as text.\n\nAnother paragraph that is long enough, too.\n\none\n\ntwo"),
    (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<!-- open", ""), ("<script>var a='<p>x</p>';</script>", ""), ("<p>a", "a"), ("a < b", "a < b"),
    ("<article><p>" + "word " * 30000 + "</p></article><p class=ad>buy</p>", ("word " * 30000).strip()),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, "u", p, "t") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extracted(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert html.extracted(pages.limit(0)).count() == 0


BODY = "<h2>Heading</h2><p>A paragraph that is long enough to count as text.</p><p>Another paragraph that is long enough, too.</p>"


@pytest.mark.parametrize("before, after", [
    ("<div class='content-with-sidebar'>", "</div>"), ("<div id='page' class='sidebar-right'>", "</div>"), ("<div class='social-science'>", "</div>"),
    ("<div class='search-article'><article>", "</article></div>"), ("<form action='x.aspx'><div>", "</div></form>"),
    ("<div class='sidebar-right'><div class='search-area'><article>", "</article></div><p>Side</p></div>"),
])
def test_main_text_inside_marked_wrappers(before, after):
    want = "Heading\n\nA paragraph that is long enough to count as text.\n\nAnother paragraph that is long enough, too."
    nav = "<nav><a href='/'>Home</a></nav>"
    assert html.main_text(f"<html><body>{nav}{before}{BODY}{after}<footer>Copyright</footer></body></html>") == want


def test_marked_parts_stay_out():
    article = f"<article>{BODY}</article>"
    want = html.main_text(f"<body>{article}</body>")
    for mark in ("comments", "related", "sidebar"):
        assert html.main_text(f"<body>{article}<div class='{mark}'><article>{BODY * 5}</article></div></body>") == want
    assert html.main_text(f"<body><div>{BODY}</div><div class='comments'><div>{BODY * 5}</div></div></body>") == want
    assert html.main_text(f"<body><div hidden><article>{BODY}</article></div></body>") == ""


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rude = ["zxqblork", "vwmuckle", "grotz", "pfooey"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, toxic))
    rows += [(600, None, 0.0), (601, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(0, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.filter("doc_id IS NULL OR doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(got[i].predicted, t) for i, t in labels if i % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[600].predicted == got[601].predicted == 0 and 0 <= got[600].score < 0.5
    none = toxicity.fit(docs, known.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_windows_cover_long_words():
    word = "".join(chr(0x4E00 + i % 40) for i in range(100)).encode()
    for long in (word, b"x" * 65, b"ab" * 300):
        parts = [p[1:] for p in toxicity.windows(long)]
        assert parts[0] == long[:len(parts[0])] and parts[-1] == long[-len(parts[-1]):] and all(p.decode() for p in parts)
        assert all(any(long[i:i + 12] in p for p in parts) for i in range(len(long) - 11))
    assert toxicity.windows(b"a" * 64 + b" b") == [b"a" * 64, b"b"]


def test_toxicity_behind_64_bytes_of_a_word(spark):
    """A line without spaces is one word; what is toxic stands behind its first 64 bytes."""
    rng = random.Random(6)
    plain = ["".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rude = ["".join(chr(c) for c in cs) for cs in ((0x6000, 0x6101, 0x6202), (0x6303, 0x6404, 0x6505), (0x6606, 0x6707))]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(40, 80))]
        toxic = int(i % 3 == 0)
        for _ in range(3 * toxic):
            words[rng.randrange(30, len(words))] = rng.choice(rude)
        rows.append((i, "".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, toxicity.fit(docs, known.filter("doc_id % 5 <> 0"))).collect()}
    held = [(got[i], t) for i, t in labels if i % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.9


def plain_pipeline_survivors(rows, accepted):
    """Smallest id of each group of the accepted documents, by the definition of the fingerprint."""
    kept = [r for r in rows if r.doc_id in accepted]
    prints = np.array([simhash.fingerprint((r.text or "").encode()) for r in kept]).view(np.uint64)
    edges = []
    for i in range(len(kept)):
        edges += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 3)]
    groups = defaultdict(list)
    for r, root in zip(kept, components(len(kept), edges), strict=True):
        groups[root].append(r.doc_id)
    return {min(ids) for ids in groups.values()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, FOLDER)
    assert first.schema == docs.schema
    accepted = {r.doc_id for r in first.collect()}
    assert len(accepted) > 0.97 * len(rows)
    second = stages["near_duplicates"](spark, first, FOLDER)
    assert {r.doc_id for r in second.collect()} == plain_pipeline_survivors(rows, accepted) and second.columns == docs.columns
    third = stages["benchmark"](spark, second, FOLDER)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in third.collect()}
    for r in second.collect():
        n, hit, _ = plain_hits(r.text, items, 10) if r.doc_id % 10 == 0 else (0, 0, "")
        if hit:
            assert hit > 0.5 * n or left[r.doc_id] != r.text
            assert r.doc_id not in left or plain_hits(left[r.doc_id], items, 10)[1] == 0
        elif r.doc_id % 10 == 0:
            assert left[r.doc_id] == r.text
    fourth = stages["surrogates"](spark, third, FOLDER)
    assert sorted(fourth.columns) == sorted(docs.columns) and fourth.count() == third.count()
    mixed = corpus_pipeline.run(spark, FOLDER)
    assert set(docs.columns) < set(mixed.columns) and 0 < mixed.count() <= third.count()
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), FOLDER).count() == 0


PARAGRAPH = "<p>This is an ordinary paragraph of the article with some words in it, long enough to be dense.</p>"


@pytest.mark.parametrize("inner,kept,gone", [
    ("<article><div class='article-header'><h1>Title</h1></div>{p}{p}</article>", ["Title", "ordinary"], ["Menu", "Copyright"]),
    ("<article>{p}<h2 class='section-header'>Second</h2>{p}</article>", ["Second"], []),
    ("<article>{p}{p}<section class='related-work'><p>Other work.</p></section></article>", ["Other work."], []),
    ("<article>{p}<figure><img src=a><figcaption class='banner-caption'>Caption</figcaption></figure>{p}</article>", ["Caption"], []),
    ("<article>{p}<p>Word <label>label</label> inside.</p>{p}</article>", ["Word label inside."], []),
    ("<main><article>{p}{p}</article><article><p>Another text of the same page, about as long as the first one was.</p>{p}</article></main>", ["ordinary", "Another text"], []),
    ("<article><p>Before</p><svg><path d='1'>{p}{p}</article>", ["Before", "ordinary"], []),
    ("<article>{p}<svg><title>Icon</title></svg>{p}</article>", ["ordinary"], ["Icon"]),
    ("<article>{p}<div class='ad'>Buy now</div>{p}<div class='ad-slot'>Deal</div></article>", ["ordinary"], ["Buy", "Deal"]),
    ("<article>{p}{p}<section class='comments'><div>A reader wrote.</div></section></article>", ["ordinary"], ["reader"]),
])
def test_the_whole_article_is_kept(inner, kept, gone):
    page = "<html><body><nav><a href=x>Menu one</a> <a href=y>Menu two</a></nav>" + inner.format(p=PARAGRAPH) + "<footer>Copyright us</footer></body></html>"
    text = html.main_text(page)
    assert all(k in text for k in kept) and not any(g in text for g in gone), text


def test_broken_pages_take_linear_time():
    n = 40_000
    start = time.perf_counter()
    for middle in ("<div>" * n + PARAGRAPH + "</span>" * n, "<svg>" * n + PARAGRAPH, "<b>" * n + "<hr>" * n + PARAGRAPH, "<p>a<b>" * n):
        assert "a" in html.main_text(f"<body>{middle}</body>")
    assert time.perf_counter() - start < 40


def test_no_document_is_lost_where_ids_repeat(spark):
    unlike = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"]
    docs = spark.createDataFrame([(5, unlike[0]), (5, unlike[1]), (6, unlike[2]), (7, unlike[1]), (5, unlike[0])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(5, unlike[0]), (5, unlike[1]), (6, unlike[2])])


def test_every_language_is_learned(spark):
    """Two hundred invented languages, each with letters of its own order."""
    rng = random.Random(6)
    syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4000)]
    text = lambda i: " ".join(rng.choice(syllables[20 * i:20 * i + 20]) + rng.choice(syllables[20 * i:20 * i + 20]) for _ in range(12))
    rows = [(f"l{i:03d}", text(i)) for i in range(200) for _ in range(2)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.languages) == 200
    asked = spark.createDataFrame([(i, text(i)) for i in (3, 190)], "doc_id long, text string")
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in language.identified(asked, model).collect())
