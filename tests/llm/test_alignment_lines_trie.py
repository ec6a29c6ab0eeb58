"""Token alignment, line dedup and the prefix trie, held against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from spindrift.llm import queries as Q
from spindrift.llm import token_alignment
from spindrift.llm.hot_join import join_by_weight
from spindrift.llm.line_dedup import line_dedup
from spindrift.llm.prefix_trie import conversation_trie, prefix_trie
from spindrift.llm.token_alignment import Aligner, align_tokens

from .conftest import EDGES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(frame, expected):
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order([tuple(r) for r in frame.collect()]) == order(expected)


# -- weighted join ---------------------------------------------------------------------------


def test_join_by_weight_equals_a_left_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)] + [(None, 1), (99, 2)], "key long, n long")
    table = rows.filter("key < 6").groupBy("key").count().selectExpr("key", "count AS weight", "CASE WHEN key > 1 THEN key * 10 END AS value")
    for parts in (1, 3, 1000):
        got = join_by_weight(rows, table, ["key"], "weight", ["n"], parts)
        same(got, [tuple(r) for r in rows.join(table, "key", "left").collect()])
        same(join_by_weight(rows, table, ["key"], "weight", None, parts), [tuple(r) for r in got.collect()])
    assert join_by_weight(rows, table.limit(0), ["key"], "weight", ["n"]).filter("value is not null").isEmpty()


# -- token alignment -------------------------------------------------------------------------


def plain_alignment(docs):
    """Token by token: groups from the offsets where both end, links from all overlaps."""
    a_tool, b_tool = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tool.encode_special_tokens = True
    tool = Aligner(BYTES, PIECES)
    rows, counts, highest = [], Counter(), Counter()
    for doc, text in docs:
        a = a_tool.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        whole = f" {text}".encode()
        if text and not (b"".join(tool.a_bytes[i] for i in a) == whole == b"".join(tool.b_bytes[i] for i in b)):
            a = b = []
        spans = []
        for ids, table in ((a, tool.a_bytes), (b, tool.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(table[i])))
                at = own[-1][2]
            spans.append(own)
        cuts = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        groups = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for i, s, e in spans[side]:
                groups[sum(c < e for c in cuts)][side].append(str(i))
        links = [(x, y) for x, s, e in spans[0] for y, f, g in spans[1] if s < g and f < e]
        counts.update(links)
        rows.append((doc, len(a), len(b), len(groups), links, ";".join(f"{','.join(x)}|{','.join(y)}" for _, (x, y) in sorted(groups.items()))))
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [(d, a, b, g, len(ls), sum(counts[p] == highest[p[1]] for p in ls), sum(counts[p] for p in ls), t) for d, a, b, g, ls, t in rows]


TEXTS = [
    (1, "The quick brown fox, jumping over. Éa ouaux!"),
    (2, None),
    (3, ""),
    (4, "<|endoftext|> and <s> </s> <unk> <0x41> are plain"),
    (5, "a mark ▁ differs"),
    (6, "日本語 🙂🙂 \u0000 x​y \t\t\n\n   end   "),
    (7, "The quick brown fox, jumping over. Éa ouaux!"),
    (7, "The quick brown fox, jumping over. Éa ouaux!"),
    (None, "no id"),
    (8, " "),
    (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20),
]


def test_alignment_matches_plain(spark):
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in TEXTS], "doc_id long, text string, n_a long, _row string").repartition(3)
    expected = plain_alignment(TEXTS)
    same(align_tokens(docs, BYTES, PIECES), expected)
    same(align_tokens(docs, BYTES, PIECES, digest=True), [(*r[:-1], r[-1] and sha(r[-1])) for r in expected])
    assert next(r for r in expected if r[0] == 5)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert align_tokens(docs.limit(0), BYTES, PIECES).count() == 0


def test_cold_pairs_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "PAIR_PARTS", 20)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    same(align_tokens(docs, BYTES, PIECES), plain_alignment(TEXTS))


def test_ids_are_those_of_the_libraries():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdeéÉß,.X'’s \t\n12٣日🙂\u200b\u0000\x1c\x85\xa0<|") for _ in range(random.randint(1, 12)))
    texts = [" ".join(word() for _ in range(random.randint(1, 60))) for _ in range(300)] + [" " * 150_000 + "x", "don't 'S we'll\r\n", "a" * 5_000]
    tool, a, b = Aligner(BYTES, PIECES), Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    for text in texts:
        x, y = tool.encode(text)
        assert x.tolist() == a.encode(f" {text}", add_special_tokens=False).ids and y.tolist() == b.encode(text)


def test_alignment_query_on_edges_and_table(spark, sf_dir, edges):
    got = {r[0]: r for r in align_tokens(edges, BYTES, PIECES).filter("doc_id IN (7, 8)").collect()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(EDGES)
    assert got[7]["n_b"] == len(b.encode(texts[7])) and got[8]["n_b"] == len(b.encode(texts[8]))
    rows = Q.op11_token_alignment(spark, sf_dir).collect()
    docs = [tuple(r) for r in Q.common.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    few = {r[0]: r for r in plain_alignment([(d, t) for d, t in docs if len(t) < 2_000])}
    assert len(rows) == len(docs)
    for r in rows:
        if r["doc_id"] in few:
            f = few[r["doc_id"]]
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*f[1:5], sha(f[7]))
    # Every link is in the corpus-wide counts once.
    assert sum(r["n_best"] for r in rows) <= sum(r["n_links"] for r in rows) and all(r["count_sum"] >= r["n_links"] for r in rows)


# -- lines -----------------------------------------------------------------------------------


def plain_lines(docs, min_chars=40, min_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or d == max(h for h in holders[key(x)] if h is not None)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_plain(spark):
    random.seed(11)
    shared = ["This line stands in many documents, word for word.", "  THIS line stands in many documents, word for word.\r", "ÉTÉ " * 12, "été " * 12, "short line", "", "x" * 39, "🙂" * 40]
    docs = [(k % 41, "\n".join(random.choice(shared) if random.random() < 0.5 else f"own line {k} {j} " * 4 for j in range(random.randint(0, 9)))) for k in range(60)]
    docs += [(None, shared[0]), (None, f"{shared[0]}\nkept"), (100, None), (101, ""), (102, "\n"), (103, "\n".join([shared[7]] * 30)), (104, f"{shared[0]}\n" * 20_000)]
    frame = spark.createDataFrame([(i, t, "c", 0) for i, t in docs], "doc_id long, text string, kept string, _key int").repartition(4)
    same(line_dedup(frame), plain_lines(docs))
    same(line_dedup(frame, min_chars=5, min_docs=2), plain_lines(docs, 5, 2))
    assert line_dedup(frame.limit(0)).count() == 0


def test_line_dedup_query_and_edges(spark, sf_dir, edges):
    docs = [tuple(r) for r in Q.common.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    same(Q.op12_line_dedup(spark, sf_dir), [(d, n, m, sha(t)) for d, n, m, t in plain_lines(docs)])
    same(line_dedup(edges), plain_lines(EDGES))


# -- prefix trie -----------------------------------------------------------------------------


def plain_trie(sequences):
    """Nodes by enumeration of all prefixes; a turn is (role, text)."""
    members = defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    words = lambda p: len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)
        ends = sorted(c for c in own if len(sequences[c]) == len(p))
        out.append(
            (
                min(own),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(own),
                children(p),
                sum(not children(q) for q in below),
                sum((len(members[q]) - 1) * words(q) for q in below),
                sha(",".join(map(str, ends))),
            )
        )
    return out


def plain_conversations(rows):
    """Rebuilt conversations of (conv_id, turn, role, text) rows without ties in turn."""
    own = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    start = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(start(c), [])[: h[c]] + own[c][h[c] :] for c in own}


def test_trie_matches_plain(spark):
    random.seed(2)
    turns = [(r, t) for r in ("user", None) for t in ("a b", "c", "", None, "d  e\tf")]
    rows = [(c, n if n else None, *random.choice(turns)) for c in [*range(0, 130), 205, -7] for n in range(random.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (300, 5, "user", "word " * 50_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, n long").repartition(3)
    expected = plain_trie(plain_conversations(rows))
    for limit in (1, 2, 15, 10_000):
        same(conversation_trie(frame, limit), expected)
    assert conversation_trie(frame.limit(0)).count() == 0


def test_trie_of_copies_and_long_shared_prefixes(spark):
    long = list(range(700))
    sequences = {c: [7, 8, 9] for c in range(0, 400, 2)} | {1: [7, 8], 3: [], 5: [], 7: [7, 8, 9, 1]}
    sequences |= {1000 + c: [*long, c // 3, c % 5] for c in range(30)} | {2000: long, 2001: long[:300]}
    frame = spark.createDataFrame([(c, ids, [1 + i % 3 for i in ids]) for c, ids in sequences.items()], "conv_id long, ids array<long>, words array<int>").repartition(5)
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie(frame, 4).collect()}
    assert got == {(r["conv_id"], r["depth"]): r for r in prefix_trie(frame, 10**6).collect()}
    assert got[0, 0]["n_convs"] == len(sequences) and got[0, 0]["n_children"] == 2 and got[0, 0]["ends_sha256"] == sha("3,5")
    assert got[0, 3]["ends_sha256"] == sha(",".join(map(str, range(0, 400, 2)))) and got[0, 3]["n_convs"] == 201
    assert got[1000, 700]["n_convs"] == 31 and got[1000, 700]["ends_sha256"] == sha("2000") and got[1000, 301]["n_convs"] == 31 and got[1000, 300]["n_convs"] == 32
    assert len(got) == 1 + 3 + 1 + 700 + 10 + 30


def test_repeated_rows_of_a_conversation_are_turns_of_it(spark):
    rows = [(1, 1, "user", "same")] * 4 + [(0, 1, "user", "same")] * 4
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_trie(frame).collect()
    assert sorted(r["depth"] for r in got) == [0, 1, 2, 3, 4] and all(r["n_convs"] == 2 for r in got)


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in Q.common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    same(Q.op13_prefix_trie(spark, sf_dir), plain_trie(plain_conversations(rows)))
