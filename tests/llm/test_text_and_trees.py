"""SentencePiece chunks, conversation tries and source divergence against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.llm import divergence, pieces, prefix_trie

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    """Documents with further columns that are named as the operators' own."""
    clash = {c: F.lit("x") for c in ("block", "range", "ids", "words", "layout", "term", "n", "g", "value", "rank")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def odd_texts(seed, n=120):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "▁", "▁▁", "\n", "\t", "\x00", "a", "the", "The", "é", "ß", "中", "字", "🙂", "　", "<s>", "</s>", "<unk>", "<0x41>", "x" * 40, "1234", ".", ",", "ing", "’", "ﬁ", "​"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block,range_", [(1 << 24, 1 << 26), (500, 2000), (1, 700)])
def test_pieces_match_the_library(spark, monkeypatch, block, range_):
    import sentencepiece

    monkeypatch.setattr(pieces, "BLOCK_BYTES", block)
    monkeypatch.setattr(pieces, "RANGE_BYTES", range_)
    texts = [None, "", " ", "▁", "a ", " a", "  ", *odd_texts(1), "long word " * 5000, "y" * 3000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id here", "en", "s"), (3, texts[30], None, None), (3, texts[30], None, None)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((d, tuple(sp.encode(t or ""))) for d, t, _, _ in rows)
    encoded = pieces.encode(docs(spark, rows), PIECES)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded, PIECES).collect())
    assert back == Counter((d, sp.decode(list(x))) for d, x in want.elements())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Counter(tuple(r) for r in pieces.digests(encoded, PIECES).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == Counter((d, len(x), sha(",".join(map(str, x))), sha(sp.decode(list(x)))) for d, x in want.elements())


def test_pieces_chunk_table_holds_each_chunk_once(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 50)
    monkeypatch.setattr(pieces, "RANGE_BYTES", 60)
    rows = [(i, "one two  three one", "en", "s") for i in range(30)] + [(99, "one ", "en", "s")]
    got = [r["chunk"] for r in pieces.chunk_table(docs(spark, rows), PIECES).collect()]
    assert sorted(got) == [" ", "  three", " one", " two"]


def test_pieces_edges(spark, tmp_path):
    assert pieces.encode(docs(spark, []), PIECES).count() == 0
    assert [list(r["ids"]) for r in pieces.encode(docs(spark, [(1, None, None, None)]), PIECES).collect()] == [[]]


def test_parentheses_against_a_stack():
    rng = random.Random(4)
    for n in (1, 2, 5, 300, 3000):
        bits, open_, left = [], 0, n
        deep = rng.random()
        while left or open_:
            if left and (open_ == 0 or rng.random() < 0.5 + deep / 3):
                bits.append(1)
                open_, left = open_ + 1, left - 1
            else:
                bits.append(0)
                open_ -= 1
        bits = [1, *bits, 0]
        stack, close, parent = [], {}, {}
        for i, b in enumerate(bits):
            if b:
                parent[i] = stack[-1] if stack else None
                stack.append(i)
            else:
                close[stack.pop()] = i
        p = prefix_trie.Parentheses(np.array(bits, dtype=np.uint8))
        at = np.array(sorted(close))
        assert p.find_close(at).tolist() == [close[i] for i in at.tolist()]
        assert p.enclose(at[1:]).tolist() == [parent[i] for i in at[1:].tolist()]


def trie_by_hand(rows):
    """All nodes of rebuilt conversations by comparing prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    }


def talk(seed, n=150):
    rng = random.Random(seed)
    rows, base = [], [(t, rng.choice(["user", "assistant", None]), "line %d é" % rng.randrange(9)) for t in range(60)]
    for c in range(n):
        if c % 7 == 3:
            continue  # some conversations, and some that others begin with, are absent
        kind, length = rng.randrange(5), rng.randint(1, 12)
        if kind == 0:
            turns = base[: rng.randint(1, 60)]
        elif kind == 1:
            turns = base[:4]
        else:
            turns = [(t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "", None, "ü" * rng.randint(1, 3)])) for t in range(length)]
        rows += [(c, *t) for t in turns]
    return rows + [(11, None, "user", "first"), (None, 1, "user", "nobody"), (16, 2, "user", "tie"), (16, 2, "user", "tie"), (10_000_000_000, 0, "user", "yes")]


@pytest.mark.parametrize("shard", [1, 2, 7, 40, 10_000])
def test_prefix_nodes_against_all_prefixes(spark, shard):
    rows = talk(shard)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("path", "key", "low", "shard", "depth")})
    got = prefix_trie.prefix_nodes(table, shard).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == trie_by_hand(rows)


def test_prefix_nodes_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert prefix_trie.prefix_nodes(empty).count() == 0
    # 1 begins with up to h turns of an absent conversation 0: a turnless one is a member of the root alone.
    many = [(c, 0, "u", "same") for c in range(0, 700_000, 7000)]
    for rows in ([(1, 0, "u", "x")], many, [(c, 0, None, None) for c in range(40)]):
        got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, schema), 3).collect()
        assert {tuple(r) for r in got} == trie_by_hand(rows)


def divergence_by_hand(rows, least, top=50):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    known, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        counts[lang, source].update(words)
        known[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in known[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        share = {s: {t: p(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        every = {t: p(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((every[t] - share[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and share[s][t] > every[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("block,held", [(1 << 20, 1_000_000), (40, 100), (7, 1)])
def test_divergence_against_dense_sums(spark, monkeypatch, block, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(block)
    words = ["the", "The", "THE", "über", "Über", "naïve", "x1y", "a_b", "don't", "中文", "z", "É", "é"] + ["w" + "abcdefgh"[i % 8] * (i // 8 + 1) for i in range(60)]
    rows = []
    for i in range(160):
        source = rng.choice(["hot"] * 4 + ["s%d" % k for k in range(8)] + [None, "", "é"])
        lo = rng.randrange(40)
        rows.append((i, rng.choice(["", "!! 12 ", None]) if rng.random() < 0.1 else " ".join(rng.choice(words[: 13 + lo]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), source))
    rows += [(900, "123 456", "en", "no terms"), (901, None, "xx", "only"), (902, "", "xx", "other"), (None, "the the", "en", "s1"), (5, "the", "en", "s1"), (5, "the", "en", "s1")]
    got = divergence.audit(docs(spark, rows), least_docs=6, block_entries=block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == divergence_by_hand(rows, 6)


def test_divergence_edges(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    assert divergence.audit(docs(spark, [(1, "a b", "en", "s")])).count() == 0
    rows = [(1, "a b", "en", "s"), (2, None, "en", None)]
    assert {tuple(r) for r in divergence.audit(docs(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()} == {("en", "s", "pair", "", 0, 1), ("en", "", "pair", "s", 0, 1)}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 9_000_000_000_000_001, 9_100_000_000_000_000_003, 12_345
    got = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)
