"""The training-data operators against brute force, round trips, held-out accuracy, and hard inputs."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from siltstone.llm import chat, decontamination, extraction, fixity, jaccard_join, kneser_ney, nearest, packing, quality, sharded, token_counts, toxicity  # noqa: E402
from siltstone.llm.common import without  # noqa: E402
from siltstone.llm.components import components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD_TEXTS = [None, "", " \n\t", "a", "a b", "a b", "É x \x1c y", "x" * 5000, "word " * 3000, "<s></s>▁ ▁", "Σίσυφος İ", "don't  ##  1２"]


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "src", "en", 7) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, length int")


# ---- 2

def sets_of(rows, width):
    out = []
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def linked(rows, width, num, den):
    sets = sets_of(rows, width)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and den * both >= num * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def near_copies(seed, n=160):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.choice([3, 12, 90, 200]))] for _ in range(n // 8)]
    common = [f"common{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        texts.append(" ".join(w + (common if rng.random() < 0.3 else [])))
    return texts


def as_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_join_matches_brute_force(spark, width, num, den):
    texts = near_copies(1) + ODD_TEXTS + ["a b c", "A B c"]
    rows = list(enumerate(texts))
    assert as_rows(jaccard_join.link(docs_of(spark, texts), width, num, den)) == linked(rows, width, num, den)


def test_join_with_frequent_tokens_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    monkeypatch.setattr(jaccard_join, "VERY", 12)
    monkeypatch.setattr(jaccard_join, "LARGE", 16)
    texts = near_copies(2, 240)
    rows = list(enumerate(texts))
    assert as_rows(jaccard_join.link(docs_of(spark, texts), 3, 90, 100)) == linked(rows, 3, 90, 100)


def test_join_with_null_and_repeated_ids(spark):
    text = " ".join(WORDS)
    texts, ids = [text, text, text + " ", "other words here", None], [None, 5, 5, 5, None]
    assert as_rows(jaccard_join.link(docs_of(spark, texts, ids), 3, 90, 100)) == linked(list(zip(ids, texts, strict=True)), 3, 90, 100)


def test_join_of_nothing(spark):
    assert jaccard_join.link(docs_of(spark, []), 3, 90, 100).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.link(docs_of(spark, []), 3, 10, 100)


def sets_by_hand(texts, width, num, den):
    texts = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["doc_id", "text", "text_id"])
    made = pa.Table.from_batches(jaccard_join._features(iter([texts]), width, num, den))
    return made.append_column("gid", made.column("doc_id")).append_column("comp", made.column("doc_id")).combine_chunks()


def test_pairs_of_near_copies_come_from_one_bucket():
    rng = random.Random(6)
    base = [f"word{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(f"new{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base) for _ in range(12)]
    made = sets_by_hand(texts, 3, 80, 100)
    index = pa.Table.from_batches(jaccard_join._index_rows(iter(made.to_batches()), 80, 100, (), b"\xff" * 4096, True)).sort_by("key")
    for name in ("block", "high", "low"):
        index = index.add_column(1, name, pa.array([0] * len(index)))
    keys = index.column("key").to_numpy()
    parts = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1)
    buckets = [index.take(pa.array(p)).combine_chunks().to_batches()[0] for p in parts]
    pairs = [(r["a"], r["b"]) for b in jaccard_join._candidates(iter(buckets), 80, 100, False) for r in b.to_pylist()]
    sets = [s for _, s in sets_of(list(enumerate(texts)), 3)]
    near = {(i, j) for j in range(12) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near and near <= set(pairs) and len(pairs) == len(set(pairs))


def test_least_keys_are_of_wanted_rows_only():
    keys = [[5, -3, 9, 7], [7, 9], list(range(20, 0, -1)), [9]]
    rows = [(k, gid, gid, 1, b"x") for gid, ks in enumerate(keys) for k in ks]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "gid", "comp", "n", "small"])
    wanted = np.packbits(np.arange(64) != 9, bitorder="little").tobytes()
    out = pa.Table.from_batches(jaccard_join._wanted_rows(iter([batch.slice(0, 3), batch.slice(3)]), wanted)).to_pylist()
    assert [(r["key"], r["gid"]) for r in out] == [(k, g) for k, g, *_ in rows if k != 9]
    for r in out:
        least = sorted(k for k in keys[r["gid"]] if k != 9)[: jaccard_join.FIRST]
        assert [k for k in np.frombuffer(r["first"], np.int64).tolist() if k < 2**63 - 1] == least


def test_folded_bitmaps_tell_unrelated_sets_apart():
    rng = random.Random(7)
    made = sets_by_hand([" ".join(f"w{rng.randrange(10**9)}" for _ in range(1152)) for _ in range(20)], 3, 80, 100)
    columns = [made.column(c).to_numpy() for c in ("n", "gid", "comp")]
    assert not jaccard_join._pairs(*columns, None, made.column("small").combine_chunks(), 80, 100, False)


def test_combination_keys_keep_every_link():
    rng = np.random.default_rng(3)
    kinds = rng.choice(3, jaccard_join.MAP_BITS, p=[0.3, 0.4, 0.3]).astype(np.uint8)
    for n in (64, 100, 300, 1000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.choice(len(x), int(len(x) * 0.05), replace=False)
            y = np.unique(np.concatenate([np.delete(x, drop), rng.integers(0, 2**63, len(drop), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 90 * (len(x) + len(y) - both):
                kx = {int(k) for level in jaccard_join._levels(len(x), 90, 100) for k in jaccard_join.combination_keys(x, level, 90, 100, kinds)}
                ky = {int(k) for level in jaccard_join._levels(len(y), 90, 100) for k in jaccard_join.combination_keys(y, level, 90, 100, kinds)}
                assert kx & ky


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 199)] + [(500, 501)], "a long, b long")
    got = components(edges).groupBy("root").count().toPandas()
    assert sorted(got["count"]) == [2, 200]


def test_without_compares_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    bad = spark.createDataFrame([(None,), (2,)], "doc_id long")
    assert [r.text for r in without(df, F.col("doc_id"), bad).collect()] == ["a"]


# ---- 3

def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,reference:string,tokens:bigint>>, formatted string")


def test_typed_parts_become_placeholders(spark):
    text = lambda s, n=1: ("text", s, None, n)
    rows = [(1, 0, "user", [text("see <|image|> "), ("image", None, "a.png", 256), ("audio", None, "b.wav", 50)], "x"), (1, 1, "assistant", [text("</s>[INST] ok"), text("\\<\\s>")], "x")]
    out = chat.format_conversations(turns_of(spark, rows))
    got = out.select("*", chat.read_back(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert got.loss == "</s>[INST] ok\\<\\s>"
    assert [(a.turn, a.place, a.kind, a.reference, a.tokens) for a in got.attachments] == [(0, 0, "image", "a.png", 256), (0, 1, "audio", "b.wav", 50)]
    assert got.expanded_tokens == 309
    assert got.formatted.count("<|image|>") == 1 and got.formatted.count("</s>") == 1
    assert got.t[1].text == "</s>[INST] ok\\<\\s>"


def test_escapes_round_trip(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", "[", "\\", "|turn|>", "/s>", "s>", "INST]", "/INST]", "|end|>", " ", "é", "\n", "$1"]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"))
    marks = re.compile(r"<s>|</s>|\[/?INST\]|<\|[a-z_]+\|>")
    for r in df.collect():
        assert r.u == r.t and not marks.search(r.e)


def test_odd_turns(spark):
    rows = [(None, None, None, None, "x"), (1, 0, "assistant", [("text", None, None, None)], "x"), (1, 0, "assistant", [("text", "b", None, None)], "x"), (1, 0, "assistant", [("text", "b", None, None)], "x")]
    got = {r.conv_id: r for r in chat.format_conversations(turns_of(spark, rows)).select("conv_id", "formatted", chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(chat.read_back(F.col("formatted"))).alias("n")).collect()}
    assert got[1].loss == "bb" and got[1].n == 3 and got[None].n == 1
    assert chat.format_conversations(turns_of(spark, [])).count() == 0


# ---- 4, 6

def test_counts_match_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD_TEXTS + ["  two  spaces ", "line\n\nline", "\x00"]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts), path, 5).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 5)


def test_counts_of_whole_documents(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    got = token_counts.count_tokens(docs, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_packing_covers_every_id(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ODD_TEXTS + near_copies(4, 60)
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "b").otherwise("c"))
    rows = packing.pack(docs, path, length=64, window=512).toPandas()
    for i, own_ids in ids.items():
        at = 0
        for r in rows[rows.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(own_ids[at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(own_ids)
            at += r.length
        assert at == len(own_ids)
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in by:
        assert (s.offset == s.length.cumsum() - s.length).all()
    sizes = by.length.sum()
    assert (sizes[:-1] == 64).all() and 0 < sizes.iloc[-1] <= 64 and sizes.index.tolist() == list(range(len(sizes)))
    assert packing.pack(docs.limit(0), path).count() == 0


def test_frequent_chunks_are_tokenized_once():
    tokens = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2", 60)
    tokenize, asked = tokens.tokenize, collections.Counter()

    def counted(word):
        asked[word] += 1
        return tokenize(word)

    tokens.tokenize = counted
    rng = random.Random(8)
    for _ in range(100):
        text = " ".join(["harbour", *("".join(rng.choices("abcdefgh", k=9)) + "." for _ in range(3)), "don't"])
        ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encode(text), "<u2").tolist() == ids
        assert len(tokens) <= 60
    assert asked["harbour"] == 1


def test_marks_after_a_word_are_not_encoded_with_it():
    tokens = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    whole, seen = tokens.tokenizer, []

    class Counted:
        def encode(self, text, **how):
            seen.append(text)
            return whole.encode(text, **how)

    tokens.tokenizer = Counted()
    marks = ["", ".", "###", ",$$$", ".%%%", "&&&", "***", "!?;:", "$%&*#", "&", "#1", "**b", "%'s"]
    for text in [w + m for w in ("harbour", "übe", "a", "iner") for m in marks]:
        assert np.frombuffer(tokens.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert "harbour###" not in seen and "übe.%%%" not in seen


def test_windows_hold_the_mixture(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 40)").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, length=128, window=4096).toPandas()
    share = rows[rows.source == "a"].groupby("window").length.sum() / rows.groupby("window").length.sum()
    assert (abs(share - 1 / 3) < 0.05).all()
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double")
    rows = packing.pack(docs, path, length=128, window=4096, targets=targets).toPandas()
    first = rows[rows.window < 3]
    assert abs(first[first.source == "a"].length.sum() / first.length.sum() - 0.5) < 0.05


# ---- 1

def test_audit_finds_all_damage(spark):
    rows = [(i, f"u{i % 7}", None if i % 50 == 0 else f"page {i} " * (i % 30)) for i in range(3000)] + [(5, "u", "x"), (5, "u", "x"), (None, None, None)]
    manifest = fixity.laid_out(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    a, b = manifest.toPandas(), fixity.damaged(manifest, None).toPandas()
    x, y = ({(str(r.file), r.offset): (r.length, r.digest) for r in t.itertuples()} for t in (a, b))
    wanted = {(k, "missing" if k not in y else "extra" if k not in x else "corrupt") for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    got = {((r.file, r.offset), r.status) for r in fixity.audit(manifest, fixity.damaged(manifest, None), span=2048).collect()}
    assert got == wanted and len(got) > 50
    assert fixity.audit(manifest, manifest).count() == 0 and fixity.audit(manifest.limit(0), manifest.limit(0)).count() == 0


def test_warc_bytes_round_trip(spark):
    df = spark.createDataFrame([("http://a", "body\r\n\r\n é"), (None, None)], "url string, html string")
    records = [bytes(r[0]) for r in df.select(fixity.warc_record(F.col("url"), F.col("html"))).collect()]
    files = spark.createDataFrame([("f", bytearray(b"".join(records))), ("g", bytearray(b"junk"))], "path string, content binary")
    got = fixity.read_warc(files).orderBy("file", "offset").collect()
    assert [(r.file, r.length, r.uri) for r in got] == [("f", len(records[0]), "http://a"), ("f", len(records[1]), ""), ("g", 4, None)]
    assert got[0].digest == hashlib.sha256(records[0]).hexdigest()


# ---- 5

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("a < b", "a < b"),
    ("<p>a&amp;b<p>c <i>d</i>e", "a&b c de"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p><b>One\n two.<br><p>Three.</article><footer>f</footer>", "T One two. Three."),
    ("<div class='comments'><p>no no no</p></div><div><p>yes yes</p></div>", "yes yes"),
    ("<script>var a='<p>x</p>'</script><p>t</p><!-- <p>c</p> -->", "t"),
    ("<body><div class=sidebar>" + "<p>side</p>" * 30 + "</div><article><p>main</p></article>", "main"),
    ("<" * 3000, "<" * 3000),
])
def test_main_text(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"), [
        ("<body><p>first</p></body><p>after</p>", "first after"),
        ("before<body><p>inside it</p></body>", "before inside it"),
        ("<article><p>one two</p><div class='ad-hoc'>three</div><div class='related-work'>four</div><p id='share-price'>five</p><div class='ad'>six</div></article>", "one two three four five"),
        ("<div class='content has-sidebar'><p>long enough a text</p><p>and more</p></div><div class='sidebar'>x</div>", "long enough a text and more"),
        ("<p>kept</p><a href=\"x>link</a>", "kept link"),
        ("<form id=all class=form><p>the page is one form</p><p>of two lines</p></form>", "the page is one form of two lines"),
        ("<article><header><h1>Title</h1></header><p>Body</p><footer>foot</footer></article><div class='comment-list'><p>a</p><p>b</p></div>", "Title Body"),
        ("<div><p>aaaa bbbb cccc dddd</p><p>eeee ffff gggg</p></div><div><p>hhhh iiii jjjj kkkk</p></div><ul><li><a href=/>x</a></li><li><a href=/>y</a></li></ul>", "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jjjj kkkk x y"),
    ])
def test_text_by_density(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<![CDATA[", "<div></i>", "<div><li>", "<a href=\"x>", "<p><b>", "</div>", "<", "<!--", "<title>"])
def test_odd_pages_take_linear_time(piece):
    began = time.time()
    extraction.main_text(piece * (500_000 // len(piece)))
    assert time.time() - began < 5


class SlowPage(HTMLParser):
    """Another implementation for well-formed pages: nested lists [tag, parts, attributes], densities by recursion."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [["body", [], {}]]

    def handle_starttag(self, tag, attributes):
        if tag == "p":
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == "p":
                    del self.stack[i:]
                    break
        if tag not in ("html", "head", "body"):
            self.stack[-1][1].append([tag, [], dict(attributes)])
            if tag not in ("br", "meta"):
                self.stack.append(self.stack[-1][1][-1])

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def slow_text(page):
    parser = SlowPage()
    parser.feed(page)
    off = ("script", "style", "title", "nav", "footer")
    inline = ("a", "b")

    def counts(x, link=False):
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            return n, 0, n * link, 0
        if x[0] in ("script", "style", "title"):
            return 0, 0, 0, 0
        own = [counts(p, link or x[0] == "a") for p in x[1]]
        c, t, lc, lt = (sum(o[i] for o in own) for i in range(4))
        return c, t + (x[0] not in inline or x[0] == "a"), lc, lt + (x[0] == "a")

    root = parser.stack[0]
    whole = counts(root)

    def density(x):
        c, t, lc, lt = counts(x)
        t -= x[0] not in inline or x[0] == "a"
        if not c or x[0] in ("script", "style", "title"):
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + math.e)
        adjusted = math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))
        return c / max(1, t) * (adjusted / math.log(base) if base > 1 else adjusted)

    def nodes(x, path):
        yield sum(density(p) for p in x[1] if not isinstance(p, str) and p[0] not in off and p[2].get("class") != "ad"), x, path
        for p in x[1]:
            if not isinstance(p, str) and p[0] not in off and p[2].get("class") != "ad":
                yield from nodes(p, [*path, x])

    _, best, path = max((n for n in nodes(root, []) if n[1][0] not in inline), key=lambda n: n[0])
    taken = next((x for x in [*path, best] if x[0] == "article"), best)

    def lines(x):
        out = [""]
        for p in x[1]:
            if isinstance(p, str):
                out[-1] += p
            elif p[0] == "br":
                out[-1] += " "
            elif p[0] not in off:
                more = lines(p)
                if p[0] in inline:
                    out[-1] += more[0]
                    out += more[1:]
                else:
                    out += [*more, ""]
        return out

    return " ".join(filter(None, (" ".join(line.split()) for line in lines(taken))))


def test_density_against_another_implementation(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert extraction.main_text(r.html) == slow_text(r.html)


def test_deep_pages_and_odd_rows(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", deep, "t"), (1, "u", deep, "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in extraction.extract(df).collect()) == [(False, "deep", 4), (False, "deep", 4), (True, "", 0)]


# ---- 7

def test_leaks_match_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    wanted = sorted(map(tuple, c.execute(f"select doc_id, item_id, n_item_shingles, n_shared from ({decontamination.OP7_SQL})").fetchall()))
    assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontamination.op7_decontamination(spark, FOLDER).collect()) == wanted


@pytest.mark.parametrize("most", [0, 1000])
def test_partial_and_short_leaks(spark, most):
    item = " ".join(WORDS)
    almost = " ".join(WORDS[:18]) + " x " + "filler " * 500
    half = " ".join(WORDS[:10])
    docs = docs_of(spark, [item.upper() + "!", almost, half, None, "", "only two words", item], [1, 2, 3, 4, None, 6, 1])
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "two WORDS", 0), (4, "...", 0), (1, item, 0)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontamination.leaks(docs, items, most_broadcast=most).collect())
    assert got == [(1, 1, 16), (2, 1, 14), (6, 3, 1)]
    assert sorted(str(r.doc_id) for r in decontamination.clean(docs, items).collect()) == ["3", "4", "None"]
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


# ---- 8, 9

def trusted_rows(n=300):
    rng = random.Random(9)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)).capitalize() + "." for _ in range(n)]
    bad = ["".join(rng.choice("QXZ#%|9") for _ in range(300)) for _ in range(20)]
    return good, bad


def test_junk_is_outside_the_band(spark):
    good, bad = trusted_rows()
    docs = docs_of(spark, good + bad + ODD_TEXTS)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good) // 2)] + [(None, 1), (9999, None)], "doc_id long, quality int")
    keep = {r.doc_id: r.keep for r in quality.grade(docs, labels).collect()}
    assert sum(keep[i] for i in range(len(good))) >= 0.98 * len(good)
    assert not any(keep[len(good) + i] for i in range(len(bad)))
    assert all(keep[len(good) + len(bad) + i] for i, t in enumerate(ODD_TEXTS) if not t or len(t) < 64)
    assert all(r.keep for r in quality.grade(docs, labels.limit(0)).collect())
    assert quality.grade(docs.limit(0), labels).count() == 0


def test_repeated_words_and_short_junk_are_outside_the_band(spark):
    good, _ = trusted_rows()
    bad = ["upsilon " * 200, "pi nu " * 80, "BUY!! NOW!! CHEAP!! PILLS!! HERE!! $$$ WWW", "#" * 50]
    short = ["alpha beta", "xi nu mu lambda", "tau upsilon pi rho"]
    docs = docs_of(spark, [*good, *bad, *short])
    labels = spark.createDataFrame([(i, 1) for i in range(len(good) // 2)], "doc_id long, quality int")
    keep = {r.doc_id: r.keep for r in quality.grade(docs, labels).collect()}
    assert [keep[len(good) + i] for i in range(len(bad))] == [False] * len(bad)
    assert all(keep[len(good) + len(bad) + i] for i in range(len(short)))


def test_probabilities_sum_to_one(spark):
    good, _ = trusted_rows(40)
    table = quality.train(docs_of(spark, good)).table()
    sums = np.exp2(table.astype(float)).reshape(-1, quality.SIZE).sum(1)
    assert np.abs(sums - 1).max() < 1e-3


def test_perplexity_doesnt_depend_on_neighbours(spark):
    good, bad = trusted_rows(40)
    model = quality.train(docs_of(spark, good))
    grams = lambda texts: quality._grams(texts, model.symbols)
    whole, begins = grams([good[0], "", bad[0]])
    assert whole[: begins[1]].tolist() == grams([good[0]])[0].tolist() and whole[begins[2] :].tolist() == grams([bad[0]])[0].tolist()


def brute_perplexities(trusted, texts):
    """The model by dictionaries: interpolated modified Kneser-Ney, order 4, every character a symbol."""
    spaced = lambda t: [" " if c in "\t\n\x0b\x0c\r" else c for c in t or ""]
    grams = lambda t: [tuple(x[i : i + 4]) for x in [[None] * 3 + spaced(t) + [None]] for i in range(len(x) - 3)]
    count = {4: collections.Counter(g for t in trusted for g in grams(t))}
    for k in (3, 2, 1):
        count[k] = collections.Counter(g[1:] for g in count[k + 1])
    cuts, total, lost = {}, collections.Counter(), collections.Counter()
    for k, c in count.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cut = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        cuts[k] = [min(max(d, 0.1), i + 0.9) for i, d in enumerate(cut)]
        for g, n in c.items():
            total[k, g[:-1]] += n
            lost[k, g[:-1]] += cuts[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(count[1]) + 1)
        if (k, g[:-1]) not in total:
            return p(g[1:])
        n = count[k][g]
        return ((n - cuts[k][min(n, 3) - 1] if n else 0) + lost[k, g[:-1]] * p(g[1:])) / total[k, g[:-1]]

    return [2 ** -np.mean([np.log2(p(g)) for g in grams(t)]) for t in texts]


def test_sharded_model_matches_brute_force(spark):
    rng = random.Random(12)
    signs = "".join(map(chr, [*range(0x430, 0x450), *range(0x410, 0x430), *range(0x4E00, 0x4E40)])) + "abcxyz ,.#"
    texts = ["".join(rng.choice(signs[i % 3 * 40 :]) for _ in range(120)) for i in range(40)]
    asked = [*texts, *(t or "" for t in ODD_TEXTS), "Ω" * 30]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(asked)], "text string, key long")
    found = {r.key: r.perplexity for r in kneser_ney.perplexities(rows, kneser_ney.train(rows.where("key < 40"))).collect()}
    assert [found[i] for i in range(len(asked))] == pytest.approx(brute_perplexities(texts, asked), rel=1e-9)


def test_packets_hold_every_count():
    texts = [None, "", "abab\n", "ж" * 300, "abab\n", "x y"]
    for shards in (1, 5):
        packets = dict(kneser_ney._packets(texts, shards))
        n, m, docs = np.sum([np.frombuffer(p, "<i8", 3) for p in packets.values()], axis=0)
        assert docs == len(texts) * len(packets)
        every = np.array(sorted({int(h) for i, p in packets.items() for h in np.frombuffer(pa.decompress(p[24:], int(np.frombuffer(p, "<i8", 2) @ [10, 6]), "zstd", asbytes=True), "<i8", int(np.frombuffer(p, "<i8", 1)[0]))}))
        sums = sum(sharded.sums(p, every, np.ones(len(every))) for p in packets.values())
        assert n == len(every) and sums.tolist() == [4 * (len(t or "") + 1) + 2 * bool(t) for t in texts]


def test_letters_beyond_the_commonest_are_told_apart(spark):
    rng = random.Random(3)
    few = ["".join(rng.choice(["мир ", "дом ", "лес "]) for _ in range(60)) for _ in range(60)]
    wide = ["".join(chr(0x4E00 + (i * 7 + j) % 90) for j in range(200)) * 2 for i in range(120)]  # 90 commoner symbols
    docs = docs_of(spark, [*few, *wide, "щшъы " * 50]).withColumn("lang", F.expr("if(doc_id < 60 or doc_id = 180, 'ru', 'zh')"))
    labels = spark.createDataFrame([(i, 1) for i in range(180)], "doc_id long, quality int")
    keep = {r.doc_id: r.keep for r in quality.grade(docs, labels).collect()}
    assert not keep[180] and sum(keep[i] for i in range(60)) >= 57
    cleaned = quality.clean(docs, labels)
    assert sorted(r.doc_id for r in cleaned.select("doc_id").collect()) == sorted(i for i in keep if keep[i]) and cleaned.columns == docs.columns


def test_toxic_words_are_learnt(spark):
    rng = random.Random(4)
    plain = lambda: [rng.choice(WORDS) for _ in range(80)]
    insult = lambda w: w[:20] + [rng.choice(["wretched", "despicable", "vermin"])] + w[20:] + ["wretched"]
    rows = [(" ".join(insult(plain()) if i % 5 == 0 else plain()), int(i % 5 == 0)) for i in range(500)]
    model = toxicity.fit(rows[:350])
    scorer = toxicity.Scorer(model)
    right = [(scorer.score(t) >= toxicity.CUT) == bool(y) for t, y in rows[350:]]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= scorer.score(t) <= 1 for t in ODD_TEXTS)
    assert toxicity.fit([]) is None and toxicity.fit([("a", 0)]) is None


def test_toxicity_of_odd_rows(spark):
    docs = docs_of(spark, [*ODD_TEXTS, None], [*range(len(ODD_TEXTS)), None])
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.sample(docs, labels))
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(ODD_TEXTS) + 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(len(ODD_TEXTS)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert toxicity.classify(docs.limit(0), None).count() == 0


# ---- 10

def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 64)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    x[100:140] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, []), (1080, [1.0, 2.0]), (None, [1.0] * 12), (1100, [None] * 12), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    for q in range(0, 500, 20):
        s = (y * y[q]).sum(1)
        best = [j for j in np.lexsort((np.arange(500), -s)) if j != q][:20]
        assert [(j, s[j]) for j in best] == got[q]
    assert set(got) == set(range(0, 500, 20))
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [8, 2048])
def test_rows_of_one_id_take_one_place(spark, monkeypatch, size):
    monkeypatch.setattr(nearest, "CANDIDATES", size)
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0, 0.0]), *((i, [float(x) for x in rng.random(3)]) for i in range(1, 31))]
    rows += [(i, [5.0 + i + float(x), *map(float, rng.random(2))]) for i in (7, 8) for x in rng.random(40)]
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -1.0), v[0])
    expected = sorted(best, key=lambda i: (-best[i], i))[:20]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == expected and [r.score for r in got] == [best[i] for i in expected]


def test_nearest_of_huge_components_and_many_rows_of_one_id(spark):
    rng = np.random.default_rng(5)
    rows = [(7, (rng.normal(size=4) * 3).tolist()) for _ in range(30)] + [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(100 + i, (rng.normal(size=4) * 1e200).tolist()) for i in range(3)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 100), 5)
    got = {q: [r.vec_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 100)}
    for q, found in got.items():
        own, scores = next(v for i, v in rows if i == q), {}
        for i, v in rows:
            if i != q:
                with np.errstate(all="ignore"):
                    scores[i] = max(scores.get(i, -np.inf), float((np.array(own) * np.array(v)).sum()))
        assert found == [i for _, i in sorted((-s, i) for i, s in scores.items())][:5]
