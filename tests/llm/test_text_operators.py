"""Decontamination, quality, secrets, token counts and the SentencePiece codec."""

import hashlib
import random
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import quality_sql
from spindrift.llm import queries as Q
from spindrift.llm.bpe import SPACE, PieceVocabulary, _varint
from spindrift.llm.decontamination import Phrases, decontaminate, phrase_table, search_shard, windows_of
from spindrift.llm.fm_index import FMIndex, suffix_order
from spindrift.llm.normalizer import Normalizer
from spindrift.llm.quality import quality_rules, repeated_words
from spindrift.llm.secrets import RULES, Scanner, redacted, secret_scan
from spindrift.llm.sentencepiece_codec import Codec, sentencepiece_decode, sentencepiece_encode
from spindrift.llm.token_counts import token_counts
from spindrift.llm.trigram_query import trigram_query

from .conftest import EDGES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- FM-index ------------------------------------------------------------------------------


@given(st.lists(st.lists(st.integers(1, 3), max_size=20), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_fm_index_finds_all_occurrences(runs, phrases):
    seq = np.array([x for r in runs for x in [*r, 0]], np.int32)

    def rest(i):
        return seq[i : i + int(np.flatnonzero(seq[i:] == 0)[0])].tolist()

    assert suffix_order(seq).tolist() == sorted(range(len(seq)), key=lambda i: (rest(i), i))
    index = FMIndex(seq, sample=4)
    rows = np.zeros((len(phrases), 5), np.int32)
    for k, p in enumerate(phrases):
        rows[k, : len(p)] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == [i for i in range(len(seq)) if seq[i : i + len(p)].tolist() == p]


def brute_contamination(docs, items, window=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, own = fold(t), set(), set()
        for p, names in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    own |= names
        out.append((d, len(w), len(hit), sorted(own), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_matches_brute_force(spark):
    random.seed(5)
    word = lambda: random.choice(["al", "be", "ga", "Dé", "e1", "zz"])
    items = [(k, " ".join(word() for _ in range(random.choice([1, 2, 13, 14, 20])))) for k in range(6)] + [(7, None), (8, ""), (None, "zz zz al"), (1, "be")]
    docs = [(k, " ".join([*(word() for _ in range(random.randint(0, 40))), *random.choice(items[:6])[1].split()])) for k in range(40)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (0, docs[0][1])]
    want = brute_contamination(docs, items)
    for block in (1 << 20, 60):  # one block, and several
        got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        rows = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_phrases_are_cut_into_measured_blocks(spark):
    items = [(k % 3, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(40)] + [(9, "short one")] * 5 + [(k, "same words") for k in range(100, 160)]
    table, blocks = phrase_table(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 13, 8000)
    rows = table.collect()
    assert blocks > 1 and {r.block for r in rows} <= set(range(blocks))
    assert sorted(r.phrase for r in rows) == sorted({p for _, t in items for p in windows_of(t.encode(), 13)})
    size = Counter()
    for r in rows:
        size[r.block] += len(r.phrase) + 16 + sum(8 + len(i) for i in r["items"])
    assert max(size.values()) <= 8000 and {len(r["items"]) for r in rows if r.phrase == b"same words"} == {60}


def test_decontamination_edges(edges, no_rows, spark):
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    assert decontaminate(edges, bench).count() == len(EDGES)
    assert decontaminate(no_rows, bench).count() == 0
    assert decontaminate(edges, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert search_shard([], Phrases([], pa.array([], pa.list_(pa.string())), 13)) == ([], [], [])
    carried = decontaminate(edges, bench, carry=tuple(edges.columns)).select("carried.*")
    assert carried.columns == edges.columns and carried.count() == len(EDGES)


# -- quality -------------------------------------------------------------------------------


def test_repeated_words():
    def brute(words):
        times = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        return len({k for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)})

    random.seed(2)
    for _ in range(200):
        words = [random.choice([b"a", b"b"]) for _ in range(random.randint(0, 40))]
        assert repeated_words(words) == brute(words)


def test_quality_edges(edges, no_rows):
    rows = {r.doc_id: r for r in quality_rules(edges).collect()}
    assert quality_rules(edges).count() == len(EDGES) and quality_rules(no_rows).count() == 0
    assert rows[2].base_failed and rows[3].n_words == 0 and rows[7].n_repeat_words == 60_000
    assert rows[7].rejected_by == ["repeat_words", "common_distance"] or "repeat_words" in rows[7].rejected_by
    kept = quality_rules(edges, carry=tuple(edges.columns)).filter("kept").select("carried.*")
    assert kept.columns == edges.columns


def test_symbol_soup_is_far_from_its_language(spark):
    good = [(k, "the cat and the dog of the house went to a field in the evening and it was late " * 1 + f"word{k} " * 2 + " ".join(f"{a}ing{k}" for a in "bcdfghlmnprst") + " and so it is that this is for them with all of it as it was in the end", "en") for k in range(30)]
    soup = [(99, " ".join(f"x{k}&&& $$$%%" for k in range(60)), "en")]
    rows = {r.doc_id: r for r in quality_rules(spark.createDataFrame(good + soup, "doc_id long, text string, lang string")).collect()}
    assert "class_distance" in rows[99].rejected_by and not rows[99].base_failed
    assert all(rows[k].kept for k in range(30))


def test_text_without_common_words_is_far_from_its_language(spark):
    """Only the common words tell these apart: characters are alike."""
    random.seed(8)
    common = "the of and to in a is that it for on was".split()
    rare = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 7))) for _ in range(4000)]
    text = lambda n, share: " ".join(random.choice(common) if random.random() < share else random.choice(rare) for _ in range(n))
    docs = [(k, text(150, 0.22), "en") for k in range(60)] + [(100, text(150, 0), "en"), (101, text(400, 0), "en"), (102, text(80, 0), "en"), (103, text(150, 0), "xx")]
    rows = {r.doc_id: r for r in quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert rows[100].rejected_by == rows[101].rejected_by == ["common_distance"]
    assert rows[102].kept and rows[103].kept  # too short to tell; no list of words
    assert all(rows[k].kept for k in range(60))


def test_common_words_are_learned_for_any_language(spark):
    """A language nobody listed has words; one without word spaces has none; rare and null
    languages are held together.  The SQL gives the same rows."""
    random.seed(11)
    frequent = [a + b for a in "bdgk" for b in "aeiou"]
    rare = ["".join(random.choice("aeiobdgk") for _ in range(random.randint(4, 7))) for _ in range(5000)]
    text = lambda n, share: " ".join(random.choice(frequent) if random.random() < share else random.choice(rare) for _ in range(n))
    han = lambda n: " ".join("".join(chr(random.randrange(0x4E00, 0x5E00)) for _ in range(8)) for _ in range(n))
    docs = [(k, text(150, 0.3), "qx") for k in range(120)] + [(200, text(200, 0), "qx")]
    docs += [(300 + k, han(120), "zh") for k in range(60)] + [(400, text(200, 0), "qy"), (401, text(200, 0.3), None), (402, None, "qx"), (403, text(120, 0.3), "")]
    docs += [(500 + k, text(120, 0.3), "qz") for k in range(20)] + [(520, text(120, 0), "qz"), (0, "x" * 40 + " y", "qx")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = {(r.doc_id, r.n_words): r for r in quality_rules(table).collect()}
    far = [k for k, r in rows.items() if not r.kept]
    assert sorted(far) == [(0, 2), (200, 200), (402, 0)]  # qz has too few documents for a list
    assert rows[200, 200].rejected_by == ["common_distance"] and rows[400, 200].common_distance is None
    con = duckdb.connect()
    con.register("frame", table.toPandas())
    con.sql("CREATE TABLE documents AS SELECT * FROM frame")
    want = con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, base_failed, kept FROM ({quality_sql.SQL})").fetchall()
    assert sorted(want) == sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.base_failed, r.kept) for r in rows.values())


# -- secrets -------------------------------------------------------------------------------


def brute_secrets(text):
    out = [(m.start(), k, m.end()) for k, r in enumerate(RULES) for m in re.finditer(r.pattern, text) if m.end(r.group) - m.start(r.group) >= r.least]
    return [(a, b, RULES[k].kind) for a, k, b in sorted(out)]


def test_secrets_match_plain_expressions(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["secret: token: abcdefgh", "ſecret=abcdefg API_KEY='abcdef'", "AKIA" + "A" * 16, "deadbeef" * 4 + "g" + "0" * 23, "ghp_" + "a" * 36, "é token=abcdefgh"]
    texts += ["eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "https://user:passw0rd@host/", "-----BEGIN RSA PRIVATE KEY-----", ""]
    assert Scanner(RULES).scan(texts) == [brute_secrets(t) for t in texts]


KEY_LINES = ["MIIEpAIBAAKCAQEA" + "kQ7+/x9Z" * 6, "b3BlbnNzaC1rZXk" + "Vt3+/yW8m" * 5 + "aBcD", "Zm9v+/9hYg=="]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"),
        ("-----BEGIN PRIVATE KEY-----\n", ""),
        ("-----BEGIN PRIVATE KEY-----\n", "\n-----END CERTIFICATE-----"),
        ("-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n", "\n"),
        ("-----BEGIN OPENSSH PRIVATE KEY-----\n", "\n-----BEGIN PUBLIC KEY-----\n"),
    ],
)
@pytest.mark.parametrize("line", ["\n", "\r\n", "\\n", "\n  > ", '\\n" +\n  "'])
def test_no_byte_of_a_private_key_remains(spark, before, after, line):
    text = "The key is\n" + before.replace("\n", line) + line.join(KEY_LINES) + after.replace("\n", line) + "\nand the prose goes on."
    found = secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), redact_as="[X]").first()
    assert found.redacted.startswith("The key is\n[X]") and found.redacted.endswith("\nand the prose goes on.")
    assert not any(part in found.redacted for part in KEY_LINES)
    assert [s.start for s in found.spans if s.kind == "private_key"] == [11]


def test_private_key_spans_leave_prose():
    own = Scanner(RULES)
    header = "-----BEGIN PRIVATE KEY-----"
    assert own.scan([f"a {header} line opens it.\nMore: words"]) == [[(2, 2 + len(header), "private_key")]]
    two = f"{header}\n{KEY_LINES[0]}\n-----END PRIVATE KEY----- between {header}\n{KEY_LINES[0]}\n-----END PRIVATE KEY-----"
    assert redacted(two, [s for s in own.scan([two])[0] if s[2] == "private_key"], "X") == "X between X"
    assert trigram_query(RULES[3].pattern) == trigram_query(header.replace("PRIVATE", "[A-Z ]*PRIVATE"))


def test_secret_query_matches_plain_expressions(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rules = {
        "assign": (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20),
        "hex": (r"[0-9a-f]+", 0, 24),
    }
    got = Q.op5_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r.n_assign for r in got)
    for r in got:
        found = {k: [m.span() for m in re.finditer(p, docs[r.doc_id]) if m.end(g) - m.start(g) >= n] for k, (p, g, n) in rules.items()}
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, i, k, b) for i, k in enumerate(rules) for a, b in found[k]))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(found[k]) for k in rules) and r.base_sha256 == sha(base)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in brute_secrets(docs[r.doc_id]))


def test_trigram_queries():
    assert trigram_query("[0-9a-f]+") is True and trigram_query("a?b?c?") is True
    assert trigram_query("abcd") == ("and", [b"abc", b"bcd"])
    assert trigram_query("(?:foo|bar)x*") == ("or", [b"foo", b"bar"]) or set(trigram_query("(?:foo|bar)x*")[1]) == {b"foo", b"bar"}
    assert trigram_query("(?:foo|x*)") is True


def test_redaction_and_edges(edges, no_rows):
    assert redacted("ab SECRET cd", [(3, 9, "k"), (5, 8, "j")], "X") == "ab X cd"
    rows = secret_scan(edges, redact_as="[X]", carry=("lang", "spans")).collect()
    assert len(rows) == len(EDGES) and secret_scan(no_rows).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert [s.kind for s in by_id[6].spans] == ["assign", "access"] and by_id[6].redacted.endswith("[X] [X]")
    assert by_id[2].redacted is None and by_id[2].spans == []


# -- tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXTS = [t or "" for _, t in EDGES if not t or len(t) < 1000] + ["a▁b", " ", " a", "\n", "  \n x", "²³.", "<s></s><0x41>", " é́", "１２３ ㎏", "x" * 300, "‍﻿"]


def test_codec_equals_the_library(library):
    codec = Codec(MODEL)
    for text in TEXTS:
        ids, starts, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert codec.decode(ids) == library.decode(library.encode(text))
        assert sum(map(codec.vocabulary.count, codec.vocabulary.chunks.findall(codec.normalizer.text(text)))) == len(ids)
        if text:
            assert starts[0] == 0 and ends[-1] == len(text.encode())
            assert all(a <= b for a, b in zip(starts, ends))


def test_spans_hold_the_pieces():
    codec = Codec(MODEL)
    for text in ("The quick fox, née 1234!", "a▁b c"):
        raw = text.encode()
        for i, a, b in zip(*codec.encode(text)):
            if not codec.is_byte[i]:
                assert raw[a:b].decode().replace(" ", SPACE) in (codec.vocabulary.pieces[i], codec.vocabulary.pieces[i].removeprefix(SPACE))


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_any_text_round_trips(text):
    codec = Codec(MODEL)
    ids = codec.encode(text)[0]
    assert codec.decode(ids) == text.replace(SPACE, " ")


def test_decoding_broken_bytes_equals_the_library(library):
    codec = Codec(MODEL)
    base = codec.vocabulary.byte_ids
    for raw in (b"\xe6\x97", b"\xff\xfe", b"a\xe6b", b"\xf0\x9f\x99\x82\xf0"):
        ids = [base[b] for b in raw]
        assert codec.decode(np.array(ids)) == library.decode(ids)


def compiled_map(pairs):
    """A double-array trie blob for one-byte-per-edge keys, built by first fit."""
    trie, texts, at = {}, b"", {}
    for key, value in pairs:
        at[key] = len(texts)
        texts += value.encode() + b"\0"
        node = trie
        for b in key.encode():
            node = node.setdefault(b, {})
        node[None] = at[key]
    units = {0: 0}
    used, bases = {0}, set()
    todo = [(0, trie)]
    while todo:
        place, node = todo.pop()
        codes = [0 if k is None else k for k in node]
        base = next(b for b in range(1, 1 << 16) if b not in bases and all(b ^ c not in used for c in codes) and (b ^ place) < 1 << 21)
        bases.add(base)  # nodes must not share one, else one's children look like the other's
        units[place] |= (base ^ place) << 10 | ((1 << 8) if None in node else 0)
        for k, child in node.items():
            used.add(base ^ (0 if k is None else k))
            if k is None:
                units[base] = child | 1 << 31
            else:
                units[base ^ k] = k
                todo.append((base ^ k, child))
    size = max(units) + 256
    blob = struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size)))
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_prefix_normalisation_keeps_offsets():
    vocabulary = PieceVocabulary(MODEL)
    vocabulary.charsmap = compiled_map([("ﬁ", "fi"), ("㎏", "kg"), ("a", "A"), ("ab", "Z"), ("\t", " "), ("­", "")])
    text, starts, ends = Normalizer(vocabulary).aligned("xab㎏\tﬁ­a")
    assert text == SPACE + "xZkg" + SPACE + "fiA"
    raw = "xab㎏\tﬁ­a".encode()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["", "x", "ab", "㎏", "㎏", "\t", "ﬁ", "ﬁ", "a"]


def test_codec_equals_the_library_with_a_real_map(tmp_path):
    """The vocabulary with a public character map in place of its empty one: ids, and spans."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    fields, at, model = [], 0, open(MODEL, "rb").read()
    while at < len(model):
        key, start = _varint(model, at)
        size, body = _varint(model, start)
        assert key & 7 == 2
        if key >> 3 != 3:
            fields.append(model[at : body + size])
        at = body + size
    size = len(spec)
    head = bytes([3 << 3 | 2])
    while size >= 128:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    path = tmp_path / "mapped.model"
    path.write_bytes(b"".join([*fields, head + bytes([size]) + spec]))
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), Codec(str(path))
    assert not codec.normalizer.plain
    for text in [*TEXTS, "Ｈｅｌｌｏ　 ①  ﬁsh", "  two  spaces ", "㎏ ﬃ ½", "a\u0301 e\u0301", "ｶﾞ", "x\u200by\t\tz "]:
        ids, starts, ends = codec.encode(text)
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], text
        for p, a, b in zip(want.pieces, starts.tolist(), ends.tolist()):
            if not codec.is_byte[p.id] and not p.piece.startswith(SPACE):
                # Of several pieces of one source the library gives its range to the last.
                assert a == p.begin and (b == p.end or p.begin == p.end), (text, p.piece)


def test_token_queries(spark, sf_dir, library):
    codec = Codec(MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op6_token_counts(spark, sf_dir).collect():
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    for r in Q.op8_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        _, starts, ends = codec.encode(docs[r.doc_id])
        assert r.spans_sha256 == sha(";".join(",".join(map(str, x.tolist())) for x in (starts, ends)))


def test_token_edges(edges, no_rows):
    assert token_counts(edges, MODEL).count() == len(EDGES) and token_counts(no_rows, MODEL).count() == 0
    coded = sentencepiece_encode(edges, MODEL, decoded=True)
    assert coded.count() == len(EDGES) and sentencepiece_encode(no_rows, MODEL).count() == 0
    assert {r.doc_id: r.ids for r in coded.collect()}[2] == []
    again = {(r.doc_id, r.decoded) for r in sentencepiece_decode(coded.drop("decoded"), MODEL).collect()}
    assert again == {(r.doc_id, r.decoded) for r in coded.collect()}


# -- hostile sizes -----------------------------------------------------------------------------


def test_one_large_phrase_does_not_multiply_the_blocks(spark):
    random.seed(8)
    text = lambda n: " ".join(random.choice("abcdefghij") * random.randint(1, 6) for _ in range(n))
    small = [(k, text(16)) for k in range(60)]
    of = lambda rows, limit: phrase_table(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", 13, limit)
    _, plain = of(small, 8000)
    table, blocks = of([*small, (99, "x" * 9_000)], 8000)
    assert blocks == plain + 1
    sizes = {r.block: r.n for r in table.groupBy("block").agg({"phrase": "count"}).withColumnRenamed("count(phrase)", "n").collect()}
    assert set(sizes) <= set(range(blocks)) and sizes[0] == 1 and sum(sizes.values()) == table.select("phrase").distinct().count()
    header = "one two three four five six seven eight nine ten eleven twelve thirteen"
    table, blocks = of([(k, header) for k in range(3_000)] + small, 8000)
    assert blocks <= plain + 1 and table.filter("size(items) = 3000").count() == 1
    # Several phrases of an eighth or more share blocks.
    table, blocks = of([(k, "y" * (1_500 + k)) for k in range(20)], 8000)
    assert blocks == 1 + 4 and table.count() == 20


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_every_rule_is_linear(rule):
    """Texts that start a match everywhere and finish none, five times as long in some five times the time."""
    import time

    hostile = {"assign": "token= ", "access": "AKIA-", "hex": "0123456789abcdefabcdefx", "private_key": "-----BEGIN PRIVATE KEY-----\nabc ", "temporary_access": "ASIA.", "code_host": "ghp_a", "chat_token": "xoxb-a.", "cloud_key": "AIza.", "payment_key": "sk_live_a_", "web_token": "eyJ", "url_password": "ab://c:d", "bearer": "bearer  "}[rule.kind]
    own = Scanner((rule,))

    def took(n):
        texts = [(hostile * (n // len(hostile)))[:n]]
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            own.scan(texts)
            best = min(best, time.process_time() - began)
        return best

    assert took(5_000_000) < 0.5 + 20 * took(1_000_000)


def test_web_tokens_start_at_the_first_mark_of_a_run():
    random.seed(6)
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
    own = Scanner(tuple(r for r in RULES if r.kind == "web_token"))
    for _ in range(500):
        text = "".join(random.choice(["eyJ", "eyJ", "abcdefghij", "A", ".", ".", " ", "-_", "é"]) for _ in range(40))
        assert [(a, b) for a, b, _ in own.scan([text])[0]] == [m.span() for m in plain.finditer(text)]
