"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrove.llm import decontaminate, jaccard, langid, linededup, media, pieces, pii, repeats, tokenids, toxicity
from tallygrove.llm.queries import QUERIES
from tests.llm import plainly

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, ids string, items string, n_words string, kept string, component_id string, _row string, h1 string, labels string"
LONG = "wörter ohne ende, " * 12_000 + "x" * 70_000
LINES = "\n".join(f"line number {i} of the text" for i in range(6))
TEXTS = [
    (None, "a row without an id, mail me@example.org"),
    (1, None),
    (2, ""),
    (3, " \n\n\n "),
    (4, LONG),
    (5, LINES),
    (6, LINES),
    (6, LINES),
    (7, "short"),
    (8, "12 34 -- 56"),
    (9, LINES.upper() + "\n" + LINES),
    (10, "the quick brown fox jumps over the lazy dog again and again today " * 3),
    (11, "é" * 60),
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 1, 0.5, *["clash"] * 9) for i, t in texts], KIND)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables as the queries read them."""
    path = str(tmp_path_factory.mktemp("edge"))
    rows(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "The quick, brown FOX jumps over the lazy dog again and again today the quick"), (1, None), (None, "short"), (3, "  "), (4, "short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (10, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    rows(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


#: Queries over documents, a row for each.
OF_DOCUMENTS = sorted(set(QUERIES) - {"op11_centroid_clusters", "op13_conversation_repair"})
#: Where equal rows have places of their own.
PLACED = ("op1_token_ids", "op12_source_mix")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_one_row_for_each(name, spark, folder):
    got = by_id(QUERIES[name](spark, folder))
    assert {i: len(r) for i, r in got.items()} == {i: sum(i == j for j, _ in TEXTS) for i, _ in TEXTS}
    again = [r.asDict() for r in got[6]]
    if name not in PLACED:
        assert again[0] == again[1]


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_tables(name, spark, bare):
    assert QUERIES[name](spark, bare).count() == 0


def test_token_ids(spark, folder):
    got = sorted(QUERIES["op1_token_ids"](spark, folder).collect(), key=lambda r: r.start)
    assert got[0].doc_id is None and got[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1]
    expected = plainly.token_ids([(r.doc_id, dict(TEXTS)[r.doc_id]) for r in got])
    assert [(r.n_tokens, r.ids_crc32) for r in got] == expected


def test_media(spark, folder):
    got = by_id(QUERIES["op2_media_sequences"](spark, folder))
    for i, text in TEXTS:
        data = (text or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = got[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_pii_defined(spark, folder):
    got = by_id(QUERIES["op3_pii"](spark, folder))
    assert got[None][0].n_email == 1 and got[1][0].spans == "" and got[2][0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_toxicity_without_both_labels(spark):
    docs = rows(spark)
    model = toxicity.fit(docs, spark.createDataFrame([(4, 0)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.predict(docs, model).collect()} == {0.0}


def test_line_dedup(spark, folder):
    got = by_id(QUERIES["op5_line_dedup"](spark, folder))
    removed = {i: r[0].n_removed for i, r in got.items()}
    assert removed[5] == 0 and removed[6] == 6 and removed[9] == 6 and removed[3] == 0
    assert (got[1][0].n_lines, got[2][0].n_lines, got[9][0].n_lines) == (0, 1, 12)
    with pytest.raises(ValueError, match="n_lines"):
        linededup.deduplicate(rows(spark).withColumn("n_lines", F.lit(1)), keep=("n_lines",))


def test_jaccard_defined(spark, folder):
    got = {i: (r[0].n_shingles, r[0].component_id) for i, r in by_id(QUERIES["op6_ngram_jaccard_join"](spark, folder)).items()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[7] == (1, 7)
    # 9 is 5 twice over, in other case: 32 of its 36 shingles are those of 5.
    assert got[6][1] == 5 and got[9][1] == 5 and got[None][1] is None


def test_jaccard_row_without_id_ahead_of_an_equal_one(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (2, text + " more")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in jaccard.cluster(df).collect()} == {None: None, 1: 1, 2: 1}


def test_repeats_defined(spark, folder):
    got = {i: r[0] for i, r in by_id(QUERIES["op7_repeated_strings"](spark, folder)).items()}
    expected = plainly.repeats([(i, t) for i, t in TEXTS if i is not None])
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items() if i is not None} == expected
    assert got[None].n_removed == 0


def test_repeats_of_one_id_with_different_texts(spark):
    passage = "".join(chr(33 + i * 7 % 90) for i in range(70))
    named = [(1, passage), (2, "before it: " + passage), (2, "clean"), (2, "q" * 30 + "another text, long enough to have strings " + "z" * 60), (2, passage + " in other words")]
    got = repeats.remove(spark.createDataFrame(named, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.kept.decode()) for r in got) == sorted([(1, passage), (2, "before it: "), (2, "clean"), (2, named[3][1]), (2, " in other words")])


def test_decontamination_defined(spark, folder):
    got = {i: r[0] for i, r in by_id(QUERIES["op8_decontamination"](spark, folder)).items()}
    assert (got[1].n_words, got[1].contaminated, got[3].n_words) == (0, False, 0)
    # An item without an id counts as the text `null`; two ids of one window are two items.
    assert (got[7].n_hit, got[7].n_items, got[7].contaminated, got[7].items_sha256) == (1, 2, True, hashlib.sha256(b"4,null").hexdigest())
    assert (got[10].n_words, got[10].n_hit) == (39, 39)


def test_decontamination_by_shuffle(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    some = decontaminate.mark(docs, items).select("doc_id", "n_hit", "items")
    other = decontaminate.mark(docs, items, broadcast_rows=0).select("doc_id", "n_hit", "items")
    assert sorted(map(str, some.collect())) == sorted(map(str, other.collect()))


def test_decontamination_of_a_long_document(spark):
    """200,000 words, items of one and two words, both ways of joining: only the places count, whatever the document's length."""
    words = [f"w{i % 997}x{i % 31}" for i in range(200_000)]
    passage = words[150_000:150_020]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "alone pair here"), (3, " ".join(passage[:12]))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(passage)), ("b", "Alone"), ("c", "pair, here"), ("d", "here pair"), ("e", " ".join(passage[:12]) + " not")], "item_id string, text string")
    for most in (decontaminate.BROADCAST_ROWS, 0):
        got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.mark(docs, items, broadcast_rows=most).collect()}
        at = [i for i in range(len(words) - 19) if words[i : i + 20] == passage]
        covered = {j for i in range(len(words) - 12) for k in range(8) if words[i : i + 13] == passage[k : k + 13] for j in range(i, i + 13)}
        assert at and got == {1: (len(covered), ["a"]), 2: (3, ["b", "c"]), 3: (0, [])}


def test_pieces_defined(spark, folder):
    got = {i: r[0] for i, r in by_id(QUERIES["op9_sentence_pieces"](spark, folder)).items()}
    assert got[1].n_pieces == 0 and got[2].n_pieces == 0
    assert all(got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in TEXTS)


def test_language_defined(spark, folder):
    got = {i: r[0] for i, r in by_id(QUERIES["op10_language_id"](spark, folder)).items()}
    assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[1].score == 0
    assert got[5].lang_pred == "en"
    untaught = langid.predict(rows(spark), langid.Model())
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_stages(spark, folder, bare):
    for path in (folder, bare):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            assert set(stage(spark, docs, path).columns) == set(corpus_pipeline.COLUMNS) or name == "encoding"
    kept = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in kept.collect()} <= {i for i, _ in TEXTS}
    assert corpus_pipeline.run(spark, bare).count() == 0


def test_operators_keep_texts_and_spans(spark):
    docs = rows(spark)
    assert linededup.deduplicate(docs, keep=("lang",)).columns == ["doc_id", "text", "lang", "n_lines", "n_removed"]
    assert pii.detect(docs).where("doc_id IS NULL").first().spans[0].value == "me@example.org"
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.decode(pieces.encode(docs, model), model).where("doc_id = 4").first().text == LONG
    frames = tokenids.write(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert tokenids.read(frames).where("doc_id = 7").first().ids[-4:] == (1).to_bytes(4, "little")
    assert repeats.remove(docs).where("doc_id = 7").first().kept == b"short"
    members, links = jaccard.join(docs)
    assert links.columns == ["a", "b"] and members.count() == len(TEXTS)


@pytest.mark.parametrize(
    "html, expected",
    [
        ('<figure><figcaption>First</figcaption><img src="a"><img src="b" alt="own"></figure>', [("media", None, "First"), ("media", None, "First")]),
        ('<figure><img src="a"><figcaption>Between</figcaption><img src="b"></figure>x', [("media", None, "Between"), ("media", None, "Between"), ("text", "x", None)]),
        ("<figure><figcaption>Alone</figcaption><pre>code</pre></figure>", [("text", "Alone", None), ("text", "code", None)]),
        ('<figure><figcaption><p>One</p><p>two</p></figcaption><img src="a">', [("media", None, "One two")]),
        ('<figure><figcaption>Lost<figure><img src="a" alt="far">', [("text", "Lost", None), ("media", None, "far")]),
    ],
)
def test_caption_ahead_of_media(html, expected):
    got = media.sequence(html)
    assert [(p["kind"], p["text"], p["caption"]) for p in got] == expected
    assert [p["position"] for p in got] == list(range(len(got)))


def test_real_pages_resolve(spark):
    stored = media.store_texts(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"))
    names = {r.doc_id: r.digest for r in stored.collect()}
    html = f'<p>Before <b>it</b></p><figure><img src="media:{names[1]}"><img src="media:{names[2]}" alt="own"><figcaption>Both &amp; all</figcaption></figure><script>no</script>After<img src="http://x/y.png" alt="far">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>plain")], "page_id long, html string")
    out = media.resolve(media.parse(pages), media.describe(stored)).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position, r.kind, r.text, r.caption, r.payload_bytes) for r in out] == [
        (1, 0, "text", "Before it", None, None),
        (1, 1, "media", None, "Both & all", 192),
        (1, 2, "media", None, "Both & all", 192),
        (1, 3, "text", "After", None, None),
        (1, 4, "media", None, "far", None),
        (3, 0, "text", "plain", None, None),
    ]
