import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tablescout.llm import near_copies, queries
from tests.llm import brute

ITEM = "seven plain words make up this item and five more follow here"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `__note` string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), "n") for i, t in enumerate(texts)], COLUMNS)


def test_stages_keep_columns_and_rows(spark, tables):
    docs = frame(spark, brute.AWKWARD).unionByName(spark.createDataFrame([(None, None, None, None, None, None)] * 2, COLUMNS))
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.count() == docs.count()


def test_one_of_each_group_stays(spark, tables):
    base = " ".join(f"w{i}" for i in range(400))
    docs = frame(spark, [base, base, base.upper(), "another text altogether", None, "", "x y"], 10)
    docs = docs.unionByName(docs.where("doc_id = 10")).unionByName(frame(spark, [base]).selectExpr("null as doc_id", "text", "lang", "source", "n_chars", "`__note`"))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, tables)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [10, 13, 14, 16]


def test_contaminated_documents_go(spark, tables):
    docs = frame(spark, [f"before {ITEM} after", ITEM.upper(), " ".join(ITEM.split()[:9]), None, "clean"])
    out = corpus_pipeline.drop_contaminated(spark, docs, tables)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4]


def test_last_stage_digests(spark, tables):
    out = corpus_pipeline.encode(spark, frame(spark, brute.AWKWARD), tables).collect()
    library = brute.tiktoken_encoding(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in out:
        text = brute.AWKWARD[r.doc_id] or ""
        assert r.ids_sha256 == brute.sha(",".join(map(str, library.encode_ordinary(text))))
        assert r.decoded_sha256 == brute.sha(text)


def test_run_on_given_tables(spark, sf_dir):
    """Each stage against brute force on what the stage before kept, on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, sf_dir).select("doc_id", "text").collect()
    rows = sorted((r.doc_id, r.text) for r in kept)
    rows = [(i, text) for (i, _), (_, _, text) in zip(rows, brute.dedup_lines(rows), strict=True)]
    sets, prints = [five_words(t) for _, t in rows], [brute.simhash(t, 5) for _, t in rows]
    similar = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    # Candidates are within 14 bits of each other, the stated recall of the search.
    pairs = [(a, b) for a, b in similar if (prints[a] ^ prints[b]).bit_count() <= near_copies.RADIUS]
    assert len(pairs) >= 0.9 * len(similar)
    rows = [rows[i] for i, c in enumerate(brute.classes(len(rows), pairs)) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {doc for doc, *_ in brute.contained(rows, items)}
    expected = {i: brute.sha(t) for i, t in rows if i not in leaked}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == expected and len(out) == len(expected)


def five_words(text):
    w = brute.words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_of_five_words(spark, tables):
    """Edited copies down to a Jaccard similarity of 0.8 go, those below stay: brute force over all pairs."""
    texts = []
    for base in range(12):
        plain = [f"b{base}w{i}" for i in range(300)]
        for edits in (0, 3, 5, 8, 20):
            gone = {(edits * 7 + base + k * 300 // max(1, edits)) % 300 for k in range(edits)}
            texts.append(" ".join("new" if i in gone else w for i, w in enumerate(plain)))
    sets = list(map(five_words, texts))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    kept = [i for i, c in enumerate(brute.classes(len(texts), pairs)) if i == c]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), tables)
    assert sorted(r.doc_id for r in out.collect()) == kept and len(kept) == 36


def test_near_dedup_of_an_empty_table_and_clashing_names(spark, tables):
    names = ["node", "place", "row", "mix", "mark", "fp", "s1", "size", "label", "least", "id", "wide"]
    docs = frame(spark, ["one two three four five six", "ONE two three four five six", "other words", None], 3)
    docs = docs.selectExpr("*", *(f"doc_id % 2 as `{n}`" for n in names))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, tables)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 5, 6]
    assert all(r["node"] == r["wide"] == r.doc_id % 2 for r in out.collect())
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), tables).count() == 0
    assert corpus_pipeline.drop_contaminated(spark, docs.limit(0), tables).count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), tables).count() == 0


def test_rows_of_one_id_choose_alike_however_dealt(spark, tables):
    text = "a text that several rows of one id have in common"
    rows = [(7, text, "en", f"s{k}", k, "n") for k in range(40)]
    chosen = set()
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows, COLUMNS).repartition(parts, "source")
        chosen |= {tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, tables).collect()}
    assert len(chosen) == 1


def test_recall_of_the_search():
    """Of copies whose similarity is 0.8 to 0.85 at least nine in ten are within both sketches' bounds."""
    import random

    draw, near, every = random.Random(5), 0, 0
    for _ in range(400):
        plain = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        edited = list(plain)
        for at in draw.sample(range(300), 6):
            edited[at] = "new"
        (a, b) = map(near_copies.shingle_hashes, (" ".join(plain), " ".join(edited)))
        if 0.8 <= jaccard(set(a), set(b)) < 0.85:
            every += 1
            prints = near_copies._simhash(a) ^ near_copies._simhash(b)
            bits = (near_copies._minima_bits(a) ^ near_copies._minima_bits(b)) >> np.array([0, near_copies.SIZE_BITS])
            far = [np.bitwise_count(x.view(np.uint64)).sum() for x in (prints, bits & np.array([-1, (1 << 32) - 1]))]
            near += far[0] <= near_copies.RADIUS and far[1] <= near_copies.APART
    assert every > 50 and near >= 0.9 * every


def test_open_groups_are_settled_in_blocks(spark, tables, monkeypatch):
    """Many loosely similar texts of one origin, few of them near copies of each other, dealt to small blocks."""
    import random

    draw = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(120):
        words = list(plain)
        for at in draw.sample(range(200), draw.choice((2, 4, 5, 6))):
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(near_copies, "BLOCK_HASHES", 2_000)
    sets = list(map(five_words, texts))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    kept = [i for i, c in enumerate(brute.classes(len(texts), pairs)) if i == c]
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), tables)
    assert sorted(r.doc_id for r in out.collect()) == kept and 1 < len(kept) < 120


def test_candidates_of_one_shuffle_miss_no_pair(spark, monkeypatch):
    """All pairs within both bounds, in small blocks, by few keys a node that are neither counted nor joined to their counts."""
    rng = np.random.default_rng(4)
    rows = []
    for base in range(60):
        own = rng.integers(0, 1 << 63, 200, np.int64)
        for edits in (0, 4, 12, 20):
            own[:edits] = rng.integers(0, 1 << 63, edits, np.int64)
            marks = near_copies._minima_bits(np.unique(own.view(np.uint64)))
            rows.append((int(near_copies._simhash(own.view(np.uint64))[0]), *map(int, marks), len(rows)))
    nodes = spark.createDataFrame(rows, "fp long, s1 long, s2 long, place long")
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    monkeypatch.setattr(near_copies, "BLOCK_SHARE", 0)
    links = {tuple(r) for r in near_copies._candidates(nodes).collect()}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    size = near_copies.SIZES
    pairs = [
        (a, b)
        for a, (fp, s1, s2, _) in enumerate(rows)
        for b, (fq, t1, t2, _) in enumerate(rows[:a])
        if far(fp, fq) <= near_copies.RADIUS
        and far(s1, t1) + far(s2 & ~size, t2 & ~size) <= near_copies.APART
        and min(s2 & size, t2 & size) >= near_copies.SIMILAR * max(s2 & size, t2 & size)
    ]
    assert len(pairs) > 100 and links <= {(b, a) for a, b in pairs}
    assert brute.classes(len(rows), list(links)) == brute.classes(len(rows), pairs)
    monkeypatch.undo()
    dealt = near_copies._dealt(nodes)
    assert dealt.count() <= 64 * len(rows) and "Join" not in dealt._jdf.queryExecution().toString()


def test_texts_without_candidates_are_not_shuffled(spark):
    texts = spark.range(3_000).selectExpr("id - 5 as place", "'t' as text")
    ends = spark.range(0, 2_000, 50).selectExpr("id - 5 as place")
    kept = {r.place for r in near_copies._named(texts, ends).collect()}
    assert {r.place for r in ends.collect()} <= kept and len(kept) <= 50
    assert near_copies._named(texts, ends.limit(0)).count() == 0
