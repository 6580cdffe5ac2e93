"""The five stages on the smallest tables, each against plain Python on its own input; op1 and op9
against their SQL; toxicity on the rows held out."""

import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of each stage's result, written and read between stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, folder = [("documents", docs)], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return {name: frame.collect() for name, frame in out}


def test_stages_keep_the_columns_of_documents(stages):
    wanted = ["doc_id", "text", "lang", "source", "n_chars"]
    for name in ("toxicity", "ngram_jaccard_join", "secret_scans", "source_mixing"):
        assert list(stages[name][0].asDict()) == wanted
    assert list(corpus_pipeline.STAGES[0]) and corpus_pipeline.ORACLE_SQL is None


def test_toxicity_stage_drops_what_the_query_predicts(spark, stages):
    toxic = {r["doc_id"] for r in QUERIES["op4_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert [r for r in sorted(stages["documents"]) if r["doc_id"] not in toxic] == sorted(stages["toxicity"])


def test_one_document_of_each_class_stays(stages):
    sets, parent = {}, {}
    for r in stages["toxicity"]:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        parent[r["doc_id"]] = r["doc_id"]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    kept = [r for r in stages["toxicity"] if root(r["doc_id"]) == r["doc_id"]]
    assert sorted(kept) == sorted(stages["ngram_jaccard_join"])


def test_secrets_are_replaced_and_nothing_else(stages):
    before, after = ({r["doc_id"]: r for r in stages[n]} for n in ("ngram_jaccard_join", "secret_scans"))
    assert before.keys() == after.keys()
    hexes, access = re.compile("[0-9a-f]{24,}"), re.compile("AKIA[A-Z0-9]{16,}")
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A)
    for doc_id, row in before.items():
        new, text = after[doc_id], row["text"] or ""
        found = any(p.search(text) for p in (hexes, access, assign))
        assert new["n_chars"] == len(new["text"])
        if found:
            assert not hexes.search(new["text"]) and not access.search(new["text"]) and not assign.search(new["text"])
        elif not secrets.scan_text(text):
            assert new["text"] == text


def test_mix_takes_whole_copies_near_the_targets(stages):
    before, taken = {r["doc_id"]: r for r in stages["secret_scans"]}, Counter(r["doc_id"] for r in stages["source_mixing"])
    assert all(before[r["doc_id"]] == r for r in stages["source_mixing"]) and max(taken.values()) <= 3
    size = {d: len(WORD.findall(r["text"] or "")) for d, r in before.items()}
    total, mixed = Counter(), Counter()
    for d, r in before.items():
        total[r["source"]] += size[d]
        mixed[r["source"]] += size[d] * taken[d]
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in total if s is None]
    weights, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * total[s] for s in over}
        open_ -= set(over)
    assert all(abs(mixed[s] - target[s]) <= max(size.values()) for s in order)


def test_tokens_decode_to_the_mix(stages):
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda text: hashlib.sha256(np.array(own.encode_ordinary(text or ""), "<u4").tobytes()).hexdigest()
    wanted = Counter((r["doc_id"], digest(r["text"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in stages["source_mixing"])
    assert wanted == Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["byte_bpe"])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[columns].astype(object).where(f[columns].notna(), None).convert_dtypes().itertuples(index=False))
    assert rows(found) == rows(wanted)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").dropna()
    scored = QUERIES["op4_toxicity"](spark, folder).filter("held_out").join(labels, "doc_id")
    got = scored.select("score", "predicted", F.col("toxic").cast("int")).collect()
    positive, negative = ([r["score"] for r in got if r["toxic"] == t] for t in (1, 0))
    above = sum(np.searchsorted(np.sort(negative), p) + 0.5 * sum(n == p for n in negative) for p in positive)
    print("held out:", len(positive), len(negative), "area", above / (len(positive) * len(negative)), "flagged", sum(r["predicted"] for r in got if r["toxic"] == 1), sum(r["predicted"] for r in got if r["toxic"] == 0))
    assert above / (len(positive) * len(negative)) >= 0.9


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, label int, word string, _word long, _bits long, size long, key double, copies int, component_id long, id long"


def awkward(rows):
    return [(i, t, "en", source, None, 0, "w", 1, 1, 0, 0.0, 1, 0, 0) for i, t, source in rows]


@pytest.mark.parametrize("name", ["toxicity", "ngram_jaccard_join", "secret_scans", "source_mixing", "byte_bpe"])
def test_stages_on_awkward_rows(spark, name):
    """Empty tables, null and repeated ids, null, empty and long texts, columns of clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], AWKWARD), SF).count() == 0
    long = " ".join(f"w{i % 5000}" for i in range(220_000))  # over a megabyte
    rows = awkward([(None, "a few words here", None), (None, None, "s"), (7, "", "s"), (7, None, "s"), (7, "the same words", "s"), (7, "the same words", "s"), (8, long, "t"), (9, "password = hunter22secret and more", "t")])
    out = stage(spark, spark.createDataFrame(rows, AWKWARD), SF)
    found = out.collect()
    if name != "byte_bpe":
        assert out.columns == [c.split(" ")[0] for c in AWKWARD.split(", ")]
    texts = Counter(r["text"] for r in found) if name != "byte_bpe" else None
    if name == "toxicity":
        assert texts.total() == 8
    elif name == "ngram_jaccard_join":
        assert texts.total() == 8 and texts["the same words"] == 2
    elif name == "secret_scans":
        assert texts.total() == 8 and texts[long] == 1 and not any("hunter22" in t for t in texts if t) and texts[None] == 2
    elif name == "source_mixing":
        assert None not in texts and "" not in texts and len(found) > 0
    else:
        assert len(found) == 8 and sorted(r["n_tokens"] for r in found)[:3] == [0, 0, 0]
