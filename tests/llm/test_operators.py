"""The training-data operators on a small table of awkward rows, against plain Python."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, byte_bpe, induced_sort, jaccard_join, mixing, quality_outliers, secrets, substring_dedup, suffix_dedup, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, block int"


def texts() -> list[tuple]:
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words, 3000))
    passage = " ".join(rng.choice(words, 120))
    out = [None, "", " \n\t", "one", "same words here", "SAME words  here", "a" * 2000, "!" * 1000 + " " * 500 + "é" * 500, long, long, long[500:4000] + " tail", long.replace("w7 ", "w8 ", 3)]
    for _ in range(30):
        body = rng.choice(words, int(rng.integers(1, 200))).tolist()
        if rng.random() < 0.5:
            body[5:5] = passage.split(" ")
        out.append(" ".join(body))
    out += [out[-1], out[-2] + " more", passage, passage + "\n" + passage]
    return [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, i, 0) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_substring_dedup(spark, docs, none):
    first: dict = {}
    for doc_id, text, *_ in texts():
        words = WORD.findall(text or "")
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), doc_id)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark, docs).collect()}
    for doc_id, text, *_ in texts():
        words = WORD.findall(text or "")
        gone = {j for i in range(len(words) - 12) if first[tuple(words[i : i + 13])] < doc_id for j in range(i, i + 13)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[doc_id]["n_words"], got[doc_id]["n_removed"], got[doc_id]["kept_sha256"]) == (len(words), len(gone), sha(kept.encode()))
    assert substring_dedup.remove_repeats(spark, none).count() == 0


def test_substring_factors_across_blocks(spark, docs):
    """Every factor holds the words of its reference, and the factors of five blocks cover the same
    words as those of one."""
    words = {d: WORD.findall(t or "") for d, t, *_ in texts()}
    found = substring_dedup.factors(spark, docs, blocks=5).collect()
    assert len(found) > 20
    for r in found:
        assert r["end"] - r["start"] >= 13 and r["ref"] < r["doc_id"]
        assert words[r["doc_id"]][r["start"] : r["end"]] == words[r["ref"]][r["ref_start"] : r["ref_start"] + r["end"] - r["start"]]
    rows = lambda n: sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark, docs, blocks=n).collect())
    assert rows(1) == rows(5)
    cover = Counter(d for d, i in {(r["doc_id"], i) for r in found for i in range(r["start"], r["end"])})
    assert [cover[d] for d, _, _ in rows(1)] == [n for _, n, _ in rows(1)]


def test_jaccard_join_of_ids_with_several_texts(spark):
    """Rows of one id are one document: a link of any of them counts, whatever the order of rows."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(200)]
    bases = [rng.choice(words, 60).tolist() for _ in range(14)]
    near = lambda b: " ".join([*b[:-1], "changed"])
    rows = [(1, " ".join(bases[0])), (1, " ".join(bases[1])), (4, near(bases[1])), (5, near(bases[0])), (9, " ".join(bases[2])), (8, " ".join(bases[2])), (8, " ".join(bases[3])), (7, near(bases[3])), (6, "")]
    rows += [(int(rng.integers(20, 30)), near(b) if rng.random() < 0.5 else " ".join(b)) for b in bases[4:] for _ in range(3)] + [(4, "")]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and (rows[i][0] == rows[j][0] or 100 * len(a & b) >= 80 * len(a | b)):
                parent[root(i)] = root(j)
    want = [(d, len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))) for i, (d, _) in enumerate(rows)]
    for order in (rows, rows[::-1]):
        found = jaccard_join.near_duplicate_classes(spark, spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(want)


def test_suffix_dedup(spark, docs, none):
    width, seen = 400, Counter()
    for _, text, *_ in texts():
        data = (text or "").encode()
        seen.update(data[i : i + width] for i in range(len(data) - width + 1))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_long_repeats(spark, docs).collect()}
    for doc_id, text, *_ in texts():
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if seen[data[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        assert (got[doc_id]["n_removed"], got[doc_id]["n_spans"]) == (sum(gone), len(re.findall(rb"\x01+", bytes(gone))))
        assert got[doc_id]["kept_sha256"] == sha(bytes(b for b, g in zip(data, gone) if not g))
    assert suffix_dedup.remove_long_repeats(spark, none).count() == 0


@pytest.mark.parametrize("memory", [1 << 28, 1000])
def test_induced_sort_with_and_without_scratch_files(memory):
    rng = np.random.default_rng(5)
    for _ in range(60):
        width, letters = int(rng.integers(1, 12)), int(rng.integers(1, 5))
        strings = [bytes(rng.integers(97, 97 + letters, int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        text, _ = induced_sort.join_strings(strings)
        order, common = induced_sort.Induction(text, width, memory).run()
        keys = [text[i : i + width].tolist() for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], common[1:]):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_jaccard_join(spark, docs, none):
    sets, parent = {}, {}
    for doc_id, text, *_ in texts():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_classes(spark, docs).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    assert jaccard_join.near_duplicate_classes(spark, none).count() == 0


def test_jaccard_join_on_light_and_templated_sets(spark):
    """Sets small enough to enumerate subsets, and long texts that share most of their words."""
    rng = np.random.default_rng(8)
    rows, template = [], [f"t{i}" for i in range(300)]
    for i in range(60):
        words = [f"x{j}" for j in rng.integers(0, 9, int(rng.integers(5, 14)))] * 2
        rows.append((i, " ".join(words[: int(rng.integers(8, len(words) + 1))])))
        rows.append((100 + i, rows[-1][1] + " end" * (i % 2)))
    for i in range(60):
        own = [f"o{i}_{j}" for j in range(int(rng.integers(10, 70)))]
        rows.append((200 + i, " ".join(template + own)))
    sets = {d: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    join = jaccard_join.JaccardJoin(spark, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in join.run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: root(d) for d in sets} and len(set(got.values())) < len(rows) - 20


def test_light_pairs_come_from_shared_subsets(spark):
    rng = np.random.default_rng(9)
    sets = {i: np.unique(rng.choice(18, int(rng.integers(3, 13)))).astype(np.uint64) for i in range(120)}
    sets = {i: v for i, v in sets.items() if not any(j < i and np.array_equal(v, w) for j, w in sets.items())}
    join = jaccard_join.JaccardJoin(spark, 5, 80)
    table = spark.createDataFrame([(i, len(v), bytearray(v.tobytes())) for i, v in sets.items()], "id long, n long, small binary")
    links = {(r["u"], r["v"]) for r in join.light_links(table, 12).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert links <= near and near and jaccard_join.choose_boundary({n: 100 for n in range(3, 13)}, 50.0, 80) > 8
    reach = lambda pairs, a: {a} | {y for p in pairs if a in p for y in p}
    for _ in range(8):
        links = links | {(min(a, c), max(a, c)) for a, b in links for d, c in links if d == b and a != c} | {(min(a, c), max(a, c)) for b, a in links for d, c in links if d == b and a != c}
    assert all(b in reach(links, a) for a, b in near)


def test_bitmaps_never_part_linked_sets():
    rng = np.random.default_rng(10)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64)))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert jaccard_join.may_link(jaccard_join.bitmap(a), jaccard_join.bitmap(b), len(a), len(b), 80)


def test_byte_bpe(docs, none):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs).collect()}
    for doc_id, text, *_ in texts():
        ids = own.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(ids) and got[doc_id]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert got[doc_id]["decoded_sha256"] == sha((text or "").encode())
    assert byte_bpe.round_trip(none).count() == 0
    codec = byte_bpe.codec(path, public.PATTERN)
    ids = codec.encode("né ☃ 你好")
    assert "".join(byte_bpe.decode_stream(codec, (ids[i : i + 4] for i in range(0, len(ids), 4)))) == "né ☃ 你好"


def test_secret_base_spans_against_plain_patterns(spark, docs, none):
    ignoring = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rules = ((ignoring, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))

    def plain(text: str) -> tuple:
        found = [(m.start(), at, m.end()) for at, (pattern, group, least) in enumerate(rules) for m in pattern.finditer(text) if len(m.group(group)) >= least]
        spans = ",".join(f"{secrets.KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(found))
        return *(sum(f[1] == kind for f in found) for kind in range(3)), sha(spans.encode())

    parts = ["password", "PassWd", "secret", "ToKen", "to\u212aen", "\u017fecret", "api_key", "APIKEY", "=", ":", " ", "  ", "\n", "'", '"', "abcde", "abcdef", "x.y/z+1=", "\u00e9", "AKIA", "AKIA" + "Q" * 15, "AKIA" + "7" * 17, "0a" * 11, "0f" * 12, "akia", "ghp_", "deadbeef"]
    rng = np.random.default_rng(5)
    mixed = ["".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(1500)]
    rows = [(i, t) for i, t in enumerate(mixed)] + [(None, "token=abcdefgh"), (7, None), (7, ""), (0, mixed[0]), (9000, "secret" * 40_000 + "=" + "a1" * 40_000)]
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, *plain(t or "")) for i, t in rows)
    assert secrets.scan_secrets(none).count() == 0


def test_secrets(spark):
    body = "A" * 30
    good = f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"
    text = f"É password: token: abcdefgh API_KEY = 'secret99' AKIA{'Z' * 16} {'0a' * 12} {good} ghp_{'B' * 36}"
    kinds = [secrets.KINDS[k] for *_, k in secrets.scan_text(text)]
    assert kinds == ["assign", "access", "hex", "github"]
    assert secrets.scan_text("") == []
    rows = spark.createDataFrame([(1, None, 0), (2, text, 0)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(rows).collect()}
    assert got[1] == "" and got[2].startswith("assign:")
    assert good not in {r["doc_id"]: r["text"] for r in secrets.redact_secrets(rows).collect()}[2]


def test_mixing(spark, docs, none):
    rows = mixing.mix_sizes(spark, docs).collect()
    again = mixing.mix_sizes(spark, docs).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(t - target) <= max(r["size"] for r in rows) for (_, target), t in taken.items())
    assert abs(sum(t for _, t in taken) - sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mix_sizes(spark, none).count() == 0 and mixing.mix_documents(spark, docs).columns == docs.columns


def test_mixing_rows_that_share_ids_and_clashing_columns(spark):
    """Rows of one id in two sources, equal rows, null ids and columns named like helpers."""
    rows = [(1, "a b c", "x", 0, 0), (1, "a b c", "y", 0, 0), (2, "d e f g", "x", 1, 0), (2, "d e f g", "x", 2, 0), (None, "h i", "y", 0, 0), (None, "j k", "y", 0, 0), (None, "h i", "y", 0, 0), (3, "l " * 40, None, 0, 0), (4, None, "x", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, identity int")
    sizes = mixing.mix_sizes(spark, docs).collect()
    mixed = mixing.mix_documents(spark, docs)
    assert mixed.columns == docs.columns and len(sizes) == len(rows)
    wanted, got = Counter(), Counter()
    for r in sizes:
        wanted[r["doc_id"], r["size"], r["source_size"]] += r["copies"]
    per = defaultdict(int)
    for r in rows:
        per[r[2]] += len(WORD.findall(r[1] or ""))
    for r in mixed.collect():
        got[r["doc_id"], len(WORD.findall(r["text"])), per[r["source"]]] += 1
    assert +wanted == got


def test_mixing_follows_the_exponential_keys(spark):
    """The fractional epoch takes the smallest keys of -ln(u) / weight, whatever the buckets."""
    docs = spark.range(3000).selectExpr("id doc_id", "'w' text", "if(id % 3 = 0, 'a', 'b') source")
    quality = spark.range(3000).selectExpr("id doc_id", "if(id % 5 = 0, 4.0D, if(id % 5 = 1, 0.3D, 1.0D)) weight")
    keys = docs.join(quality, "doc_id").withColumn("key", mixing.exponential_key(mixing.identity(17), F.col("weight"))).collect()
    copies = {r["doc_id"]: (r["copies"], r["target"], r["source_size"]) for r in mixing.mix_sizes(spark, docs, quality, bucket_rows=50).collect()}
    for source in "ab":
        order = [r["doc_id"] for r in sorted(keys, key=lambda r: r["key"]) if r["source"] == source]
        whole, target, size = min(copies[d][0] for d in order), copies[order[0]][1], copies[order[0]][2]
        many = [copies[d][0] - whole for d in order]
        assert many == sorted(many, reverse=True) and abs(whole * size + sum(many) - target) <= 1


def test_quality(spark, docs, none):
    got = {r["doc_id"]: r for r in quality_outliers.quality_rules(spark, docs).collect()}
    for doc_id, text, *_ in texts():
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert (got[doc_id]["n_words"], got[doc_id]["word_chars"], got[doc_id]["n_repeat_words"], got[doc_id]["n_dup_lines"]) == (len(words), sum(map(len, words)), len(repeated), len(lines) - len(set(lines)))
        assert got[doc_id]["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert got[doc_id]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
    assert quality_outliers.quality_rules(spark, none).count() == 0


def test_chi_square():
    for share, degrees, wanted in ((0.975, 5, 12.8325), (0.75, 5, 6.6257), (0.95, 1, 3.8415), (0.9999, 5, 25.7448)):
        assert abs(quality_outliers.chi_square_quantile(share, degrees) - wanted) < 1e-3
    rng = np.random.default_rng(0)
    d2 = np.sort(np.square(rng.standard_normal((200_000, 5))).sum(1))
    assert abs(quality_outliers.consistency(0.75, 5) * d2[:150_000].mean() / 5 - 1) < 0.02


def test_robust_outliers_go_and_clean_rows_stay(spark):
    """A fifth of one group lies together far off, which would drag a plain mean and covariance along."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((400, 5)) @ np.array([[1, 0.5, 0, 0, 0.2], [0, 1, 0.3, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0.6], [0, 0, 0, 0, 1]]) + 5
    base[:80] = rng.standard_normal((80, 5)) * 0.5 + [16, -9, 17, -8, 15]
    names = list(quality_outliers.FEATURES)
    rows = [(i, "en" if i % 2 else None, "s", 100, *map(float, v)) for i, v in enumerate(base)] + [(1000 + i, "xx", "few", 100, *map(float, v)) for i, v in enumerate(base[:20])]
    table = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, " + ", ".join(f"{n} double" for n in names))
    space = quality_outliers.Workspace(spark, "test")
    got = {r["doc_id"]: r for r in quality_outliers.mcd_outliers(space, table).collect()}
    assert all(got[i]["outlier"] for i in range(80)) and not any(got[i]["outlier"] for i in range(1000, 1020))
    assert sum(got[i]["outlier"] for i in range(80, 400)) <= 3
    clean = base[81::2]
    away = np.linalg.inv(np.cov(clean.T))
    plain = [float((base[i] - clean.mean(0)) @ away @ (base[i] - clean.mean(0))) for i in range(81, 400, 2)]
    assert np.corrcoef(plain, [got[i]["distance2"] for i in range(81, 400, 2)])[0, 1] > 0.97
    # Equal rows at the bound of a core are all in it, and a group without spread gives no verdict.
    flat = spark.createDataFrame([(i, "en", "s", 100, 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(60)], table.schema)
    assert not any(r["outlier"] for r in quality_outliers.mcd_outliers(space, flat).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows = [*vectors, (300, vectors[0][1]), (301, None), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8)]
    got = ann.nearest_neighbours(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    stored = {i: np.array(v, np.float32).astype(float) for i, v in rows[:301]}
    for q in (0, 100, 200, 300):
        wanted = sorted((float(np.sqrt(np.square(stored[i] - stored[q]).sum())), i) for i in stored if i != q)[:10]
        assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == wanted
    assert ann.nearest_neighbours(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_through_a_forest(spark):
    rng = np.random.default_rng(2)
    plane = rng.standard_normal((6, 24))
    points = (rng.standard_normal((3000, 6)) @ plane).astype(np.float32)
    points[100:160] = points[100]  # a large group of equal vectors
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(3001, [1.0] * 5)]
    rows.append(rows[50])
    found = ann.nearest_neighbours(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50, leaf_rows=64, exact_rows=500, query_block=16).collect()
    stored, hits = points.astype(float), 0
    assert {r["query_id"] for r in found} == set(range(0, 3000, 50))
    for q in range(0, 3000, 50):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        distances = np.sqrt(np.square(stored - stored[q]).sum(1))
        assert [r["rank"] for r in own] == list(range(1, 11)) and q not in {r["vec_id"] for r in own}
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((float(distances[r["vec_id"]]), r["vec_id"]) for r in own)
        wanted = [i for _, i in sorted((d, i) for i, d in enumerate(distances) if i != q)[:10]]
        hits += len(set(wanted) & {r["vec_id"] for r in own})
    assert hits >= 0.9 * 600


def test_toxicity_index_is_exact(monkeypatch):
    """Several blocks of examples, matrix rows beside inverted lists, and examples left out."""
    for name, value in (("BLOCK", 32), ("DENSE", 8), ("SEEDS", 5)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(4)
    at = np.array([np.sort(rng.choice(np.arange(300) + 300 * (i % 3), 30, False)) for i in range(401)])
    times, idf = rng.integers(1, 9, (401, 30)), rng.random(900) + 0.1
    vectors = [toxicity.weigh((a, n), idf) for a, n in zip(at, times)]
    whole = np.zeros((401, 900))
    for i, (a, w) in enumerate(vectors):
        whole[i, a] = w
    index = toxicity.BlockMaxIndex(401, np.repeat(np.arange(401), 30), at.ravel(), times.ravel(), idf)
    without = [-1] * 50 + list(range(50, 100))
    for i, near in enumerate(index.nearest(vectors[:100], 15, without)):
        cosines = whole @ whole[i]
        wanted = sorted(((float(c), j) for j, c in enumerate(cosines) if c > 0 and j != without[i]), key=lambda x: (-round(x[0], 12), x[1]))[:15]
        assert [j for _, j in near] == [j for _, j in wanted] and np.allclose([c for c, _ in near], [c for c, _ in wanted])


def test_toxicity_against_brute_force(spark):
    """Evidence and scores of a whole run, with conflicting labels, copies, null and empty texts."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'Vile,' if i % 3 == 0 and rng.random() < 0.4 else 'kind'}{j}" for j in rng.choice(60, int(rng.integers(1, 25))))) for i in range(220)]
    rows += [(220, rows[3][1]), (221, None), (222, ""), (223, ", ."), (None, rows[5][1]), (7, rows[7][1])]
    labels = {i: int(i % 3 == 0) for i in range(160)} | {220: 0}
    terms = lambda text: Counter(t for w in (text or "").lower().split() if (t := w.strip(toxicity.STRIP)))
    examples: dict[tuple, int] = {}
    for i, text in sorted((r for r in rows if r[0] in labels), key=lambda r: r[0]):
        examples.setdefault((text, labels[i]), i)
    df, per = Counter(), {0: Counter(), 1: Counter()}
    for _, text in rows:
        df.update(set(terms(text)))
    for text, y in examples:
        per[y].update(set(terms(text)))
    n0, n1 = (sum(y == v for _, y in examples) for v in (0, 1))
    idf = {}
    for t in per[0].keys() | per[1].keys():
        a, b = per[0][t], per[1][t]
        chi2 = (n0 + n1) * (a * (n1 - b) - b * (n0 - a)) ** 2 / (n0 * n1 * (a + b) * max(n0 + n1 - a - b, 0.5))
        odds = abs(np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1)))
        idf[t] = np.log((1 + len(rows)) / (1 + df[t])) * (3 if a + b >= 3 and chi2 >= 20 and odds >= np.log(4) else 1)

    def vector(text):
        v = {t: (1 + np.log(n)) * idf[t] for t, n in terms(text).items() if t in idf}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    known = sorted((i, y, vector(text)) for (text, y), i in examples.items())
    prior = sum(y for _, y, _ in known) / len(known)

    def vote(text, left_out=None):
        own = vector(text)
        near = sorted(((sum(x * v.get(t, 0) for t, x in own.items()), i, y) for i, y, v in known if i != left_out), key=lambda s: (-round(s[0], 12), s[1]))
        near = [s for s in near if s[0] > 0][:15]
        votes = [(1 / (1.05 - min(1.0, c)), y) for c, _, y in near]
        return ((sum(w * y for w, y in votes) + prior) / (sum(w for w, _ in votes) + 1) if near else -1.0), [i for _, i, _ in near]

    steps = toxicity.isotonic_steps([(vote(text, i)[0], y) for (text, y), i in examples.items()])
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")
    got = Counter((r["doc_id"], round(r["score"], 9), tuple(r["evidence"])) for r in toxicity.score_toxicity(spark, docs, spark.createDataFrame(list(labels.items()), "doc_id long, label int"), evidence=15).collect())
    wanted = [(i, *vote(t)) for i, t in rows]
    assert got == Counter((i, round(float(np.interp(v, *steps)), 9), tuple(near)) for i, v, near in wanted)


def test_toxicity_of_equal_texts_is_equal(spark):
    """Twins of examples under other ids score like the examples themselves."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"{'vile' if (i % 2) ^ (rng.random() < 0.2) else 'kind'}{j}" for j in rng.choice(25, 6)), i % 2) for i in range(150)]
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), *((i + 1000, t) for i, t, _ in rows)], "doc_id long, text string")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")).collect()}
    assert all(scored[i] == scored[i + 1000] for i in range(150)) and len(set(scored.values())) > 1


def test_toxicity_finds_a_copy_of_rare_words(spark):
    """No word of the copied example tells the labels apart; it is searched all the same."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'vile' if i % 2 else 'kind'}{j}" for j in rng.choice(30, 10)), i % 2) for i in range(200)]
    rows.append((200, "quartz lattice hums under seven pale moons", 1))
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (300, rows[-1][1] + " tonight")], "doc_id long, text string")
    scored = toxicity.score_toxicity(spark, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"))
    assert {r["doc_id"]: r["evidence"] for r in scored.filter("doc_id = 300").collect()} == {300: [200]}


def test_toxicity_on_empty_tables(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in toxicity.score_toxicity(spark, docs, labels).collect()} == {0.0}
    assert toxicity.score_toxicity(spark, none, labels).count() == 0


def test_warc(spark):
    pages = [(1, "http://a b", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "u", None, 0), (4, "u", "é\r\n\r\nWARC/1.0", 0), (None, "u", "", 0)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, payload int").repartition(2)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark, table).collect()}
    assert got == {1: (8, "revisit", 2), 2: (8, "response", None), 3: (0, "response", None), 4: (14, "response", None), None: (0, "revisit", 3)}
    assert warc.archive_pages(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("members", [1, 3])
def test_archives_of_other_makers(spark, tmp_path, version, members):
    """Records without our header, in one gzip member or one each: declared lengths, identifiers, digests."""
    bodies = [b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>one\nhttp://a 1 2 3 4</p>\n\n", b"HTTP/1.0 200 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nsame"]
    block = f"{version} 0 other\n{warc.ARC_FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 other.arc" if version == 2 else ""
    parts = [f"filedesc://other.arc 1.2.3.4 19990102030405 text/plain{extra} {len(block)}\n".encode() + block]
    parts += [f"http://x/{i} 1.2.3.4 1999010203040{i} text/html{extra} {len(b)}\n".encode() + b + b"\n" for i, b in enumerate(bodies)]
    data = b"".join(map(gzip.compress, parts)) if members > 1 else gzip.compress(b"".join(parts))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "other.arc.gz").write_bytes(data)
    warc.convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    rows = warc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    entities = [b.partition(b"\r\n\r\n")[2] for b in bodies]
    assert sorted((r["payload_bytes"], r["payload_digest"], r["record_type"], r["page_id"]) for r in rows) == sorted((len(e), warc.digest(e), "response", None) for e in entities)
    ids = {r["record_id"] for r in rows}
    assert len(ids) == 3 and all(re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    assert warc.record_id("http://x/1", "1999-01-02T03:04:01Z", warc.digest(b""), None) in ids


def test_byte_bpe_tries_no_more_ends_than_tokens_have():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    machine = byte_bpe.Transducer({bytes([i]): i for i in range(256)} | {b"ab": 256, b"cab": 257, b"x" * 2: 258})
    machine.tails = Counted(machine.tails)
    assert machine.encode(b"zcabyab" * 8) == [ord("z"), 257, ord("y"), 256] * 8
    assert machine.tails.asked <= 56 * 4  # each byte, and what some token ends with; it was 56 * 57 / 2 or the longest token's length before
    pieces = byte_bpe.Pieces(machine, 4)
    assert [pieces[p] for p in ("ab", "q", "ab")] == [b"\0\1\0\0", b"q\0\0\0", b"\0\1\0\0"] and list(pieces) == ["ab", "q"]
    assert [len(pieces[str(i)]) // 4 for i in range(100)] == [1] * 10 + [2] * 90 and len(pieces) <= 4
