"""SimHash near-duplicates, conversation repair and fill-in-middle against plain Python."""

import hashlib
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
import xxhash

from tidemark.llm import conversation_repair, fill_in_middle, sifting, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, key binary, n int, fp string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents() -> list[tuple]:
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)] + ["É", "ÀÈ", "日本", "😀"]
    base = rng.choice(words, 400).tolist()
    texts = [None, "", " \n\t", "one", "Two  words", "two words", "a<P>b", "x" * 3000, "😀é" * 700, " ".join(base)]
    for i in range(40):
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(len(own)))] = "changed"
        texts.append("\n".join(own) if i % 5 else " ".join(own).upper())
    texts += [" ".join(rng.choice(words, int(rng.integers(1, 300)))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[20]), (3, texts[20]), (7, "x" * 2999), (None, texts[11]), (None, None), (8, "😀é" * 700)]
    return [(i, t, b"k", 1, "f") for i, t in rows]


def plain_fingerprint(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple], most: int) -> dict:
    """Smallest doc_id by fingerprint, all pairs compared."""
    parent = {f: f for _, f in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= most:
                parent[root(a)] = root(b)
    by_id: dict = {}
    for d, f in prints:
        if d is not None:
            parent[root(by_id.setdefault(d, f))] = root(f)
    smallest: dict = {}
    for d, f in prints:
        if d is not None:
            smallest[root(f)] = min(d, smallest.get(root(f), d))
    return {f: smallest.get(root(f)) for f in parent}


@pytest.mark.parametrize("longest", [4096, 3])
def test_simhash_near_duplicates(spark, longest):
    rows = documents()
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    lowest = components(prints, 3)
    found = simhash_dedup.near_duplicates(spark, spark.createDataFrame(rows, DOCS), longest=longest).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=key) == sorted(((d, f"{f:016x}", lowest[f]) for d, f in prints), key=key)
    assert len({c for c in lowest.values()}) < len(lowest)
    assert simhash_dedup.near_duplicates(spark, spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("most", "longest"), [(1, 4), (3, 4096), (3, 4), (4, 4)])
def test_links_of_crowded_fingerprints(spark, most, longest):
    """Fingerprints around few centres, far more than lists may hold: the same components as all pairs."""
    rng = np.random.default_rng(most)
    fps = set()
    for centre in (0, (1 << 64) - 1, 0x0123456789ABCDEF):
        for _ in range(120):
            flips = rng.choice(64 if rng.random() < 0.3 else 12, int(rng.integers(0, 7)), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    prints = [(i, f) for i, f in enumerate(sorted(fps))]
    lowest = components(prints, most)
    rows = [(int(np.uint64(f).view(np.int64)),) for _, f in prints]
    join = simhash_dedup.SimHashJoin(spark, most, longest)
    links = [(int(np.int64(r["u"]).view(np.uint64)), int(np.int64(r["v"]).view(np.uint64))) for r in join.links(spark.createDataFrame(rows, "fp long")).collect()]
    assert all((u ^ v).bit_count() <= most for u, v in links)
    parent = {f: f for _, f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    assert len({root(f) for f in parent}) == len(set(lowest.values()))


def test_forests_by_masks_and_by_members():
    rng = np.random.default_rng(1)
    members = np.unique(rng.integers(0, 1 << 12, 1500).astype(np.uint64))
    few = simhash_dedup.spanning_links(members, 2)
    assert len(few) == len(members) - len(set(components([(i, int(m)) for i, m in enumerate(members)], 2).values()))
    assert all((u ^ v).bit_count() <= 2 for u, v in few)


KEEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows: list[tuple]) -> tuple:
    """Damage, faults and the least of all cheapest edits, by a search over suffixes."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [row] * (2 if fate == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    state, seen = [], set()
    for _, role, text in out:
        solid = "".join(WORD.findall(text))
        state.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i: int, last: str, inserted: int) -> tuple[int, str]:
        ways = [(0, "")] if i == len(out) and last in ("", "a") else []
        if inserted < 3:
            cost, word = best(i, NEXT[last], inserted + 1)
            ways.append((cost + 2, "I" + word))
        if i < len(out):
            cost, word = best(i + 1, last, 0)
            ways.append((cost + 3, "D" + word))
            if state[i] not in ("blank", "duplicate"):
                extra, initial = state[i] == "truncated", out[i][1][:1]
                if initial in KEEP[last]:
                    cost, word = best(i + 1, initial, 0)
                    ways.append((cost + extra, "K" + word))
                cost, word = best(i + 1, NEXT[last], 0)
                ways.append((cost + extra + 2, "R" + word))
        return min(ways, default=(1 << 20, ""))

    sys.setrecursionlimit(20_000)
    cost, audit = best(0, "", 0)
    lines, last, left = [], "", iter(out)
    for letter in audit:
        turn, role, text = next(left) if letter != "I" else (None, "", "")
        if letter != "D":
            role = role if letter == "K" else {"u": "user", "a": "assistant"}[NEXT[last]]
            last = role[:1]
            lines.append((role, text))
    turns = [t for t, *_ in out if t is not None]
    initials = [r[1][:1] for r in out]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(state.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines)), lines,
    )


def conversations() -> list[tuple]:
    rng = np.random.default_rng(9)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User"], ["Hello there.", "Hm", "Why?", "", " \n", "No! ", "Long. text", None, "é?"]
    rows = []
    for conv in range(400):
        for turn in range(int(rng.integers(1, 12))):
            tidy = rng.random() < 0.7
            role = ("system", "user", "assistant")[0 if turn == 0 and rng.random() < 0.3 else 1 + turn % 2] if tidy else roles[int(rng.integers(len(roles)))]
            text = f"Answer {turn}." if tidy else texts[int(rng.integers(len(texts)))]
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.03 else turn * (1 + conv % 3), role, text))
            if rng.random() < 0.03:
                rows.append(rows[-1])
    rows += [(1000, t, "user" if t % 3 else "assistant", f"t{t}." if t % 4 else "same.") for t in range(700)]
    return rows


SHAPE = "conv_id long, turn long, role string, text string, n int, digest string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [4096, 5])
def test_conversation_repair(spark, block):
    rows = conversations()
    table = spark.createDataFrame([(*r, 0, "d") for r in rows], SHAPE).repartition(5)
    own: dict = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    want = {conv: plain_repair(some) for conv, some in own.items()}
    work = conversation_repair.ConversationRepair(spark, conversation_repair.damaged(table), block=block)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in work.audits(table).collect()}
    assert got == {conv: w[:-1] for conv, w in want.items()}
    assert {"", "K"} & {w[-3] for w in want.values()} and {"D", "I", "K", "R"} == set("".join(w[-3] for w in want.values()))
    lines: dict = {}
    for r in sorted(work.conversations().collect(), key=lambda r: r["turn"]):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert lines == {conv: w[-1] for conv, w in want.items() if w[-1]}


def test_conversation_repair_of_nothing(spark):
    assert conversation_repair.repair_conversations(spark, spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("run", [64, 3])
@pytest.mark.parametrize("unit", [fill_in_middle.CODE_POINT, fill_in_middle.WORD_UNIT])
def test_fill_in_middle(spark, unit, run):
    rows = documents()
    found = fill_in_middle.rewritten(spark, spark.createDataFrame(rows, DOCS), unit=unit, run=run)
    found = found.select("*", fill_in_middle.restored().alias("back")).collect()
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        units = list(text) if unit == fill_in_middle.CODE_POINT else re.findall(f"{unit}", text)
        digest = sha(f"1:{'' if doc_id is None else doc_id}")
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        want.append((doc_id, len(units), form, *((None, None) if form == "plain" else (len(prefix), len(middle))), text, output, text))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    digests = fill_in_middle.fill_in_middle(spark, spark.createDataFrame(rows, DOCS), unit=unit, run=run).collect()
    assert all(r["restored_sha256"] in {sha(w[5]) for w in want} for r in digests) and len(digests) == len(rows)


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.fill_in_middle(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_sifting_by_ids(spark):
    rows = [(None if i % 50 == 0 else i % 700, f"t{i}") for i in range(1000)]
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 900, 3)], "doc_id long")
    found, rest = ([tuple(r) for r in f(docs, ids).collect()] for f in (sifting.only_ids, sifting.without_ids))
    assert sorted(found) == sorted(r for r in rows if r[0] is not None and r[0] % 3 == 0)
    assert sorted(rest, key=str) == sorted((r for r in rows if r[0] is None or r[0] % 3), key=str)
