"""Operators against brute force, and the agreed edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import bag_minhash, chat_format, decontaminate, language_id, license_queries, license_scan, near_dedup, packing
from sightline.llm import quality_classifier, quality_rules, substring_dedup, textops, url_filter
from sightline.llm import components as component_tables
from sightline.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rule string, verdict string, score double, items string, n_words long"


def documents(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame(
        [(i, t, lang, source, len(t or ""), "r", "v", 0.5, "i", 7) for i, t, lang, source in rows], DOCS)


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    """Nulls in every column, empty and blank texts, one very long text, repeated rows and ids."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    return [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"), (2, None, "en", "a"), (3, "", None, "a"),
        (4, " \n\t ", "en", None), (None, "text without an id but with some words in it", "en", "a"), (6, long, "en", "a"),
        (7, "twice the same row", "en", "b"), (7, "twice the same row", "en", "b"), (8, "same id, first text", "en", "b"),
        (8, "same id, other text", "en", "b"), (9, "###", "de", "b"), (10, "naïve café — été", "fr", "b")]


# Words -------------------------------------------------------------------------

def test_word_groups_match_regex():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\x0b\x1cé—Z9_") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, ""]
    for table, fold, pattern in (
            (textops.NOT_SPACE, textops.SAME_BYTES, rb"[^\x20\x09-\x0D]+"),
            (textops.ALPHANUMERIC, textops.LOWER_ASCII, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for kind in (pa.string(), pa.large_string()):
            got = [[] for _ in texts]
            seen = {}
            for w in textops.word_groups(pa.array(["x", *texts], kind)[1:], table, fold):
                for s, e, r, h in zip(w.starts, w.ends, w.rows, w.hashes):
                    word = fold[w.data[s:e]].tobytes()
                    got[w.first_row + r].append(word)
                    assert seen.setdefault(word, h) == h
            want = []
            for t in texts:
                data = (t or "").encode()
                if fold is textops.LOWER_ASCII:
                    data = data.lower()
                want.append(re.findall(pattern, data))
            assert got == want
            assert len(set(seen.values())) == len(seen)


# Packing -----------------------------------------------------------------------

def test_packing_round_trip(spark, edge_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_file())
    tokenizer.encode_special_tokens = True
    docs = documents(spark, edge_rows).repartition(3)
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    want = collections.Counter()
    for i, t, *_ in edge_rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[(i, ids.tobytes())] += 1
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u2").astype("<u4")
        assert len(ids) == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"], p, ids))
    stream = []
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s in sorted(by_sequence):
        at = 0
        for offset, length, p, ids in sorted(by_sequence[s], key=lambda x: x[0]):
            assert offset == at
            at += length
            stream.append((p, ids))
        assert at == 1024 or s == max(by_sequence) and at <= 1024
    got = collections.Counter()
    current = []
    for p, ids in stream:
        assert p["start"] == sum(map(len, current))
        current.append(ids)
        if sum(map(len, current)) == p["doc_tokens"]:
            got[(p["doc_id"], np.concatenate(current).astype("<u4").tobytes())] += 1
            current = []
    assert not current and got == want
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_unusual_characters():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_file())
    tokenizer.encode_special_tokens = True
    encoder = packing.Encoder(packing.vocabulary_file())
    rng = random.Random(5)
    letters = "ab'st \n\t\x0b\x1c²½ªéßñ—’日本٣_.#<|endoftext|>"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", "don't 'tis"])
        assert np.frombuffer(encoder.encode(text), dtype=encoder.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_pre_tokens_and_memory(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_file())
    tokenizer.encode_special_tokens = True
    rng = random.Random(6)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "X", "É", "ß", "ſ", "×", "÷", "¿", "«", "‐", "‧", "1", " ", "  ", "\n", "\t", "\r\n", ".", "_"]
    usual = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "'", "\n", "x'r", " 's"]
    data = np.frombuffer(b"".join(t.encode() + b"\xff" for t in usual), dtype=np.uint8)
    pieces = [p.tobytes() for p in np.split(data, packing.pre_token_starts(data)[1:])]
    want = []
    for t in usual:
        want += [t[b:e].encode() for _, (b, e) in tokenizer.pre_tokenizer.pre_tokenize_str(t)] + [b"\xff"]
    assert pieces == want

    # Many texts at once, in groups, through a memory that is full again and again.
    monkeypatch.setattr(packing, "GROUP_CHARS", 400)
    texts = [*usual, "日本 don't", "²\x0b", *usual[:50]]
    rng.shuffle(texts)
    whole = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for memory in (1 << 25, 2000, 1):
        monkeypatch.setattr(packing, "MEMORY_BYTES", memory)
        encoder = packing.Encoder(packing.vocabulary_file())
        assert [np.frombuffer(x, dtype=encoder.kind).tolist() for x in encoder.encode_all(texts)] == whole
        assert encoder.known.nbytes + encoder.ids.nbytes <= max(memory, 60)


def test_packing_asks_the_tokenizer_for_many_pre_tokens_at_once(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(8)) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(400)]
    encoder = packing.Encoder(packing.vocabulary_file())
    asked = []
    plain = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda some: asked.extend(some) or plain(some))
    want = [plain([t])[0] for t in texts]
    assert [encoder.encode(t) for t in texts[:10]] + encoder.encode_all(texts[10:]) == want
    # One text per call with new pre-tokens, not one per pre-token; none of them twice.
    assert len(asked) <= 11
    found = collections.Counter(w for t in asked for w in t.split("\n") if w)
    assert max(found.values()) == 1 and {w.strip() for w in found} == {w for t in texts for w in t.split(" ")}


# Decontamination ---------------------------------------------------------------

def brute_contamination(docs, bench):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, bt in bench:
            b = words(bt)
            size = min(len(b), 10)
            for k in range(max(len(b) - 9, 1) if b else 0):
                for j in range(len(w) - size + 1):
                    if w[j:j + size] == b[k:k + size]:
                        hit |= set(range(j, j + size))
                        items.add(str(item))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_words, piece_words", [(1_000_000, 50_000), (20, 50_000), (20, 4), (1_000_000, 1)])
def test_decontamination_brute_force(spark, edge_rows, pass_words, piece_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", pass_words)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece_words)
    rng = random.Random(8)
    bench = [(1, sentence(rng, 25)), (2, "Short ITEM here"), (10, sentence(rng, 14)), (11, None), (12, ""), (2, sentence(rng, 12))]
    texts = [sentence(rng, 20) + " " + bench[0][1][30:] + "\n" + sentence(rng, 5), "x short item, HERE y", bench[2][1].upper() + " " + bench[5][1]]
    rows = [r for r in edge_rows if r[0] != 6] + [(100 + k, t, "en", "a") for k, t in enumerate(texts)]
    docs = documents(spark, rows)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contamination_digest(decontaminate.find_contamination(docs, frame))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute_contamination([(r[0], r[1]) for r in rows], bench)
    kept = decontaminate.decontaminate(docs, frame)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    cut = decontaminate.decontaminate(docs, frame, mode="span")
    assert cut.count() == len(rows)
    assert decontaminate.find_contamination(cut, frame).where("size(hit_spans) > 0").count() == 0
    assert decontaminate.find_contamination(docs, frame.limit(0)).where("size(hit_spans) > 0").count() == 0


def test_decontamination_passes_of_a_very_long_text(spark, edge_rows, monkeypatch):
    """Passes agree with one scan on a long text, on repeated rows, and on items longer than a pass."""
    long = edge_rows[5][1]
    bench = spark.createDataFrame(
        [(1, " ".join(long.split()[500:900])), (2, " ".join(long.split()[29_980:])), (2, "twice the same row"), (3, "twice the same row")],
        "item_id long, text string")
    docs = documents(spark, edge_rows)
    columns = ["doc_id", "text", "n_words", "hit_spans", "items"]
    whole = decontaminate.find_contamination(docs, bench).select(columns).collect()
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 60)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 30)
    assert sorted(decontaminate.find_contamination(docs, bench).select(columns).collect(), key=repr) == sorted(whole, key=repr)
    by_id = {r.doc_id: r for r in whole}
    assert by_id[6].hit_spans == [500, 900, 29_980, 30_000] and by_id[6].items == ["1", "2"]
    assert by_id[7].items == ["2", "3"] and sum(r.doc_id == 7 for r in whole) == 2


# Substring dedup ---------------------------------------------------------------

def brute_substrings(rows, size=35):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[j:j + size]) for _, w in docs for j in range(len(w) - size + 1))
    out = []
    for i, w in docs:
        gone = set()
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j:j + size])] > 1:
                gone |= set(range(j, j + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [500, 1])
def test_substring_brute_force(spark, edge_rows, limit, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANCHOR_CONTEXTS", limit)
    rng = random.Random(11)
    passage, other = sentence(rng, 60), sentence(rng, 36)
    texts = [sentence(rng, rng.randrange(80)) + "\n" + passage[rng.randrange(60):] + " " + sentence(rng, rng.randrange(50)) for _ in range(30)]
    texts += [other, "x " + other, "la " * 80, sentence(rng, 34), passage + " " + passage, sentence(rng, 200)]
    texts += [texts[0], sentence(rng, 40) + "  " + sentence(rng, 40)]
    rows = edge_rows + [(100 + k, t, "en", "a") for k, t in enumerate(texts)]
    docs = documents(spark, rows)
    cut = substring_dedup.remove_repeated(docs)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").encode().split() and [w.decode() for w in (r.text or "").encode().split()])) for r in cut.collect()], key=repr)
    assert got == brute_substrings([(r[0], r[1]) for r in rows])
    assert [c for c in cut.columns if c not in ("n_words", "n_removed")] == [c for c in docs.columns if c != "n_words"]
    assert substring_dedup.remove_repeated(docs.limit(0)).count() == 0


def test_suffix_automaton():
    rng = random.Random(2)
    lists = [[rng.choice("ab") for _ in range(rng.randrange(40))] for _ in range(20)]
    automaton = substring_dedup.SuffixAutomaton()
    for words in lists:
        automaton.add(words, 1)
    automaton.finish()
    seen = collections.Counter(tuple(w[j:j + 7]) for w in lists for j in range(len(w) - 6))
    for words in [*lists, [rng.choice("abc") for _ in range(60)]]:
        assert sorted(automaton.repeated(words, 7)) == [j for j in range(len(words) - 6) if seen[tuple(words[j:j + 7])] > 1]


# Near dedup --------------------------------------------------------------------

def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    a = {int(x): int(c) for x, c in zip(rng.integers(1, 2**63, 40), rng.integers(1, 60, 40))}
    b = {x: max(1, c + int(d)) for (x, c), d in zip(a.items(), rng.integers(-20, 20, 40))}
    b.update({int(x): 5 for x in rng.integers(1, 2**63, 5)})
    keys = a.keys() | b.keys()
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    rows = np.repeat([0, 1], [len(a), len(b)])
    elements = np.array([*a, *b], dtype=np.uint64)
    weights = np.array([*a.values(), *b.values()], dtype=np.int64)
    got = bag_minhash.signatures(rows, elements, weights, 3, 4096)
    assert abs((got[0] == got[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    assert (got[2] == 0).all() and (got[:2] != 0).all()
    alone = bag_minhash.signatures(np.zeros(len(b), dtype=np.int64), elements[rows == 1], weights[rows == 1], 1, 4096)
    assert (alone[0] == got[1]).all()


def brute_classes(rows):
    bags = []
    for _, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        bags.append(collections.Counter(tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))) if w else None)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                common = sum((bags[i] & bags[j]).values())
                if 10 * common >= 8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                    parent[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        classes[find(i)].append(doc)
    return sorted((tuple(sorted(c, key=repr)) for c in classes.values()), key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_brute_force(spark, edge_rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(21)
    base = sentence(rng, 120).split()
    texts = []
    for _ in range(25):  # near copies of one text, many of them not near to each other
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = "other" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    chain = sentence(rng, 100).split()
    for k in range(8):  # a chain: neighbours are near, ends are not
        chain[k * 12] = f"link{k}"
        texts.append(" ".join(chain))
    texts += [sentence(rng, 60) for _ in range(10)] + ["la " * 300, "la " * 290, texts[0], texts[0], "a b", "a b"]
    rows = edge_rows + [(100 + k, t, "en", "a") for k, t in enumerate(texts)]
    docs = documents(spark, rows)
    got = near_dedup.near_duplicate_classes(docs)
    # Nulls and blanks are alone; the other classes follow from their ids.
    by_class = collections.defaultdict(list)
    for k, r in enumerate(got.collect()):
        alone = r.doc_id in (2, 3, 4, 9) or r.doc_id is None or r.doc_id == 8 and r.class_size == 1
        by_class[(r.class_id, k if alone else None)].append(r.doc_id)
    assert sorted((tuple(sorted(c, key=repr)) for c in by_class.values()), key=repr) == brute_classes([(r[0], r[1]) for r in rows])
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = sorted(min(c) for c in brute_classes([(r[0], r[1]) for r in rows]) if None not in c)
    assert ids == want
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def joins_without_hint(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"\bJoin \w+", x) and "strategy=merge" not in x]


def noting_joins(monkeypatch, module) -> list[str]:
    """Gets the joins without a hint in the tables that ``module`` writes from now on."""
    found, plain = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: found.extend(joins_without_hint(df)) or plain(df))
    return found


def test_labels_are_not_broadcast(spark, monkeypatch):
    """Catalyst takes labels, repeated per salt, for less than they are; at size they outgrow the driver."""
    found = noting_joins(monkeypatch, component_tables)
    links = [(i, i + 1) for i in range(9)] + [(20, 20 + i) for i in range(1, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 0 if x < 20 else 20 for link in links for x in link}
    assert found == []


def test_nodes_are_not_broadcast(spark, monkeypatch):
    """Only joins on the digest, whose sizes are measured while the query runs, may become broadcasts."""
    found = noting_joins(monkeypatch, near_dedup)
    rng = random.Random(6)
    base = [sentence(rng, 50).split() for _ in range(3)]
    texts = [" ".join(w[:49] + [f"end{k}"]) for w in base for k in range(3)] + ["some other words in a text"] * 2
    got = near_dedup.near_duplicate_classes(documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]))
    assert {r.doc_id: (r.class_id, r.class_size, r.keep) for r in got.collect()} == {
        **{k: (k // 3 * 3, 3, k % 3 == 0) for k in range(9)}, 9: (9, 2, True), 10: (9, 2, False)}
    found += joins_without_hint(got)
    assert len(found) == 2 and all("digest" in x for x in found)


# Chat formatting ---------------------------------------------------------------

def test_chat_escape_is_reversible():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "\n", "im_end", "a", chat_format.START, chat_format.END]) for _ in range(rng.randrange(12)))
        assert "<|" not in chat_format.escape(text)
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text
        messages = [(text, text), ("assistant", text), ("user", "<")]
        formatted, spans = chat_format.render(messages)
        assert chat_format.parse(formatted) == messages
        assert chat_format.unescape(formatted[spans[-2]:spans[-1]]) == text


def test_chat_events_fold(spark):
    events = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", ""), (1, 2, "delta", None, None, "hel"),
        (1, 3, "delta", None, None, "lo"), (1, 4, "message", None, "user", "more"), (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", None, None, "new"), (1, 7, "unknown", None, None, "x"), (1, 8, "edit", 0, None, "hey"), (1, 9, "edit", 7, None, "no"),
        (2, 0, "delta", None, None, "lost"), (2, 1, "message", None, None, None), (None, 0, "message", None, "assistant", "<|im_end|>")]
    frame = spark.createDataFrame(events, "conv_id long, seq long, kind string, target long, role string, text string")
    got = {r.conv_id: chat_format.parse(r.formatted) for r in chat_format.format_chats(frame.repartition(3)).collect()}
    assert got == {1: [("user", "hey")], 2: [("", "")], None: [("assistant", "<|im_end|>")]}
    assert chat_format.read_back(chat_format.format_chats(frame.limit(0))).count() == 0


# URL filter --------------------------------------------------------------------

def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw):])[0]
        host = raw.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h) + len(p or ""), len(h), a, h + (p or "")) for h, p, a in rules
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_url_filter_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("b.example.org", "", "allow"),
             ("b.example.org", "", "block"), ("co.uk", "/x", "block"), (None, "/", "block"), ("com", None, "block")]
    rng = random.Random(9)
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "http://a.b.example.org", "x://example.org/en/12?q#f", "http://.org/", "http://a..org/",
            "http://user@a.Example.org:80/es/", "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://xorg/", "http://é.com/é/", "a://b://example.org/es/"]
    urls += ["http://" + ".".join(rng.choice(["a", "b", "example", "org", "com", "co", "uk"]) for _ in range(rng.randrange(1, 5)))
             + rng.choice(["", "/", "/es/", "/en/1", "/en/21", "/x", "?a/es/", "#/"]) for _ in range(300)]
    rows = [(k, u, "r", "v") for k, u in enumerate(urls)] + [(5, urls[5], "r", "v"), (None, urls[6], "r", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    got = sorted([tuple(r) for r in url_filter.judge_urls(pages, frame).collect()], key=repr)
    assert got == sorted([(r[0], *brute_verdict(r[1], rules)) for r in rows], key=repr)
    assert url_filter.judge_urls(pages, frame.limit(0)).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    assert url_filter.judge_urls(pages.limit(0), frame).count() == 0


# Quality rules -----------------------------------------------------------------

def test_quality_counts_brute_force(spark, edge_rows):
    rng = random.Random(12)
    texts = ["a b c d e " * 6, "x y\n\nx y\n \nx y", "la la la la la la la la la la la", sentence(rng, 50), "A#b $ <|>\n%"]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20)]
    rows = edge_rows + [(100 + k, t, "en", "a") for k, t in enumerate(texts)]
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        twice = {j + k for j in range(len(w) - 4) if grams[tuple(w[j:j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice),
                     len(w) < 10 or 100 * len(twice) > 20 * len(w)))
    judged = quality_rules.judge_quality(documents(spark, rows))
    got = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert judged.where("base_failed AND kept").count() == 0
    assert quality_rules.judge_quality(documents(spark, rows).limit(0)).count() == 0


def test_adaptive_fence_differs_by_group(spark):
    rng = random.Random(13)
    rows = []
    for k in range(240):
        group = "code" if k % 2 else "prose"
        words = sentence(rng, 60).split()
        if group == "code":
            words = [w + "$" * rng.randrange(1, 4) for w in words]
        rows.append((k, " ".join(words), "en", group))
    rows.append((1000, " ".join(w + "$$" for w in sentence(rng, 60).split()), "en", "prose"))
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(documents(spark, rows)).collect()}
    assert not kept[1000] and sum(kept.values()) == 240


def test_fence_spreads_come_from_the_sketches(spark):
    rng = random.Random(14)
    rows = []
    # Source a never has symbols, b has some in one document of five, so its quartiles are equal but its language has a tail.
    for k in range(400):
        words = sentence(rng, 80).split()
        if k >= 200 and k % 4 == 0:
            words = [w + "$" for w in words[:20]] + words[20:]
        rows.append((k, " ".join(words), "en", "a" if k < 200 else "b"))
    # Another language has none at all: only chance is allowed there and two symbols pass, twenty do not.
    rows += [(1000 + k, sentence(rng, 80), "de", "a") for k in range(200)]
    rows += [(2000, sentence(rng, 80) + " $$", "de", "a"), (2001, sentence(rng, 80) + " " + "$" * 20, "de", "a")]
    docs = documents(spark, rows)
    limits = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.measured(docs)).collect()}
    assert limits["en", "a"].level_symbols == 1 and limits["en", "a"].max_symbols > 0
    assert limits["de", "a"].level_symbols is None and limits["de", "a"].max_symbols == 0
    assert limits["en", "a"].level_word_length == 0
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs).collect()}
    assert all(kept[k] for k in range(400)) and kept[2000] and not kept[2001]


def test_planted_junk_and_good_documents(spark):
    from sightline.llm.rules_queries import op8

    sf = "/root/testdata/sf0.1"
    judged = op8(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in judged.groupBy("quality", "base_failed", "kept").count().collect()}
    assert n[0, False, True] <= 0.05 * (n[0, False, True] + n[0, False, False])
    assert n[1, False, False] <= 0.01 * n[1, False, True]


# Language ----------------------------------------------------------------------

def test_viterbi_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 5, 1, 7, 3, 0])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    got, at = language_id.viterbi(scores, lengths, 2.0), 0
    import itertools
    for n in lengths:
        part = scores[at:at + n]
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(part[i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
            assert tuple(got[at:at + n]) == best
        at += n


def test_viterbi_in_pieces_is_viterbi():
    rng = np.random.default_rng(2)
    for n, languages in ((1, 1), (40, 3), (300, 5), (60, 400)):
        scores = (rng.normal(size=(n, languages)) * 3).astype(np.float32)
        whole = language_id.viterbi(scores, np.array([n]), 4.0)
        for piece in (1, 7, n):
            bounds = np.append(np.arange(0, n, piece), n)
            assert np.array_equal(language_id.viterbi_in_pieces(lambda a, b: scores[a:b], bounds, languages, 4.0), whole)


def test_language_of_long_texts_and_many_languages(spark, monkeypatch):
    """Pieces of words and of bytes give what a whole text gives; more than 256 languages are told apart."""
    rng = random.Random(15)
    own = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(300)}
    rows = [(k, " ".join(rng.choice(w) for _ in range(80)), lang, "a") for k, (lang, w) in enumerate(own.items())]
    model = language_id.train(documents(spark, rows))
    assert model.languages == sorted(own)
    long = " ".join(rng.choice(own[f"l{k // 500:03d}"]) for k in range(2_000))
    docs = documents(spark, [*rows, (1000, long, None, None), (1001, None, None, None), (1002, "", None, None), (1003, "".join(own["l007"]) * 30, None, None)])
    columns = ["doc_id", "lang_pred", "score", "lang_spans"]
    whole = {r.doc_id: r for r in language_id.identify(docs, model).select(columns).collect()}
    assert all(whole[k].lang_pred == r[2] for k, r in enumerate(rows))
    assert [(s.start, s.end, s.lang) for s in whole[1000].lang_spans] == [(500 * k, 500 * k + 500, f"l{k:03d}") for k in range(4)]
    monkeypatch.setattr(language_id, "SCORES_AT_ONCE", 5_000)
    assert {r.doc_id: r for r in language_id.identify(docs, model).select(columns).collect()} == whole
    words = next(textops.word_groups(pa.array([f"ab {'xyz' * 50} c"]), language_id.LETTERS, textops.LOWER_ASCII))
    expected = language_id.word_scores(model, words)
    for size in (2, 3, 149, 150):
        monkeypatch.setattr(language_id, "BYTES_AT_ONCE", size)
        assert np.allclose(language_id.word_scores(model, words), expected, rtol=1e-5)


def test_language_held_out_accuracy(spark):
    from sightline.llm.language_queries import op7

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = op7(spark, sf).join(docs, "doc_id")
    held = found.where("held_out")
    assert held.count() > 200
    assert held.where("lang = lang_pred").count() > 0.98 * held.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_edges(spark, edge_rows):
    rng = random.Random(14)
    en = " ".join(rng.choice("the of and in to that with from this".split()) for _ in range(300))
    ru = " ".join(rng.choice("и в не на что с по это как".split()) for _ in range(300))
    model = language_id.train(documents(spark, [(1, en, "en", "a"), (2, ru, "ru", "a"), (3, None, "xx", "a"), (4, "no lang", None, "a")]))
    assert model.languages == ["en", "ru"]
    mixed = " ".join(en.split()[:20] + ru.split()[:30])
    out = {r.doc_id: r for r in language_id.identify(documents(spark, [*edge_rows[:6], (50, mixed, None, None), (51, "12 345", "en", "a"), (52, "“ ”", "en", "a")]), model).collect()}
    assert [(s.start, s.end, s.lang) for s in out[50].lang_spans] == [(0, 20, "en"), (20, 50, "ru")]
    assert out[50].lang_pred == "ru" and all(out[k].lang_pred == "und" and out[k].score == 0 for k in (2, 3, 4, 51, 52))
    empty = language_id.train(documents(spark, []))
    assert {r.lang_pred for r in language_id.identify(documents(spark, edge_rows), empty).collect()} == {"und"}


# Licences ----------------------------------------------------------------------

def test_license_inheritance(spark):
    filler = "some other words that stand here for the rest of the page"
    rows = [
        (1, "h/a/x", "Released under the MIT License.\n" + filler), (2, "h/a/y", filler), (3, "h/a/b/c/z", filler),
        (4, "h/a/b/w", "Licensed under CC BY-NC 4.0.\n" + filler), (5, "h/q", filler), (6, None, filler), (7, "h/a/v", None),
        (8, "h/a/b/c/u", filler + "\nThis work is licensed under the GNU General Public License, version 3."), (2, "h/a/y", filler), (9, "", ""),
        (10, "h/q2", "the license of this work")]
    rows += [(100 + k, f"g/{k}", filler + f" w{k}") for k in range(50)]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "page_id long, path string, text string"), "page_id", "path", "text")
    got = {r.file_id: (r.own_license, r.license, r.origin) for r in found.collect()}
    assert got[1] == ("MIT", "MIT", "own") and got[2] == (None, "MIT", "h/a") and got[3] == (None, "CC-BY-NC-4.0", "h/a/b")
    assert got[4] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own") and got[8] == ("GPL-3.0", "GPL-3.0", "own")
    assert got[5] == got[6] == got[9] == got[10] == got[100] == (None, None, None) and got[7] == (None, "MIT", "h/a")
    assert found.count() == len(rows)
    assert license_scan.scan_licenses(found.limit(0).select("file_id", "path", F.lit("").alias("text")), "file_id", "path", "text").count() == 0


def test_license_query_inherits_on_pages(spark, tmp_path):
    rng = random.Random(5)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
               "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    rows, own, dirs = [], {}, {}
    for k in range(240):
        own[k] = rng.choice(sorted(notices)) if rng.random() < 0.12 else None
        dirs[k] = f"h{k % 6}.example" + "".join(f"/{rng.choice('ab')}" for _ in range(rng.randrange(4)))
        words = " ".join(rng.choice("alpha beta gamma delta of and the in".split()) for _ in range(30))
        # Every eighth page is its host alone, which counts as the host's directory; some have no host at all.
        url = f"http://{dirs[k]}/{k}"
        if k % 8 == 3:
            dirs[k] = f"h{k % 6}.example"
            url = f"https://{dirs[k].upper()}" + ("", "?q=1", "#top")[k % 3]
        elif k % 8 == 5:
            dirs[k], url = None, (None, "not a url", f"h1.example/{k}", "")[k // 8 % 4]
        rows.append((k, url, f"<html><head><title>{words[:30]}</title></head><body><p>{words}</p>"
                     f"<p>{notices.get(own[k], words[:20])}</p><footer>{words[:12]}</footer></body></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    votes = {}
    for k in own:
        if own[k] and dirs[k]:
            votes.setdefault(dirs[k], collections.Counter())[own[k]] += 1
    said = {d: min(v, key=lambda name: (-v[name], name)) for d, v in votes.items()}

    def expected(k):
        if own[k]:
            return own[k], own[k], "own"
        steps = (dirs[k] or "").split("/")
        near = next((d for n in range(len(steps), 0, -1) if (d := "/".join(steps[:n])) in said), None)
        return None, said.get(near), near

    got = {r.page_id: (r.own_license, r.license, r.origin) for r in license_queries.op5(spark, str(tmp_path)).collect()}
    assert got == {k: expected(k) for k in own}
    assert sum(origin not in (None, "own") for _, _, origin in got.values()) > 20


def test_license_within_longer_lines(spark):
    rng = random.Random(6)
    notices = ["This page is licensed under CC BY 4.0.", "All content is licensed under CC BY 4.0",
               "Copyright 2024 Acme. Licensed under the Apache License, Version 2.0.",
               "Our code lives elsewhere. Everything here is released under the MIT License, unless it says otherwise somewhere else.",
               "Released under\nthe MIT\nLicense"]
    wanted = ["CC-BY-4.0", "CC-BY-4.0", "Apache-2.0", "MIT", "MIT"]
    common = "this page is all content our code here it the of and in to what says else".split()
    for n in (200, 6000):
        rows = [(k, f"g/{k}/p", " ".join(rng.choice(common) + " " for _ in range(8)) + f"w{k}") for k in range(n)]
        rows += [(n + k, f"h/{k}/p", "A title\n" + notice) for k, notice in enumerate(notices)]
        found = license_scan.scan_licenses(spark.createDataFrame(rows, "page_id long, path string, text string"), "page_id", "path", "text")
        got = {r.file_id: r.own_license for r in found.where("own_license IS NOT NULL").collect()}
        assert got == {n + k: name for k, name in enumerate(wanted)}


def test_license_headers_files_and_tags(spark, tmp_path):
    mit = ("MIT License\n\nCopyright (c) 2024 Acme\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction")
    bsd = next(t for n, t in license_scan.TEMPLATES if n == "BSD-2-Clause")
    gpl = (" * This file is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.")
    files = {
        "a/LICENSE": mit, "a/x": "int main", "b/COPYING": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.",
        "c/x.c": "/*\n" + gpl.format(3), "c/y.c": gpl.format(2), "d/x": "MIT License", "d/y": "int main", "e/x": "Apache License\nVersion 2.0, January 2004",
        "f/LICENSE": "Copyright (c) 2024, Acme\n" + bsd, "f/LICENSE3": "Copyright (c) 2024, Acme\n" + bsd + " 3. Neither the name of Acme nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "g/x": "a word on the MIT License in a sentence", "g/y": "MIT"}
    rows = [(p, p, t) for p, t in files.items()] + [(f"z/{k}", f"z/{k}", f"some other words of the file w{k}") for k in range(300)]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "id string, path string, text string"), "id", "path", "text")
    got = {r.file_id: (r.own_license, r.license) for r in found.collect()}
    own = {"a/LICENSE": "MIT", "b/COPYING": "GPL-3.0", "c/x.c": "GPL-3.0", "c/y.c": "GPL-2.0", "d/x": "MIT", "e/x": "Apache-2.0",
           "f/LICENSE": "BSD-2-Clause", "f/LICENSE3": "BSD-3-Clause"}
    assert {k: o for k, (o, _) in got.items() if o} == own
    assert got["a/x"] == (None, "MIT") and got["d/y"] == (None, "MIT") and got["g/x"] == got["z/1"] == (None, None)

    pages = [(1, "Licensed under the <a href='/x'>Apache License</a>, <b>Version</b> 2.0", "Apache-2.0"),
             (2, "Released under<!-- > --> the <em>MIT</em> License", "MIT"), (3, "Nothing here", None)]
    spark.createDataFrame([(k, f"http://h{k}.example/p", f"<title>T</title><p>{t}</p><p>end</p>") for k, t, _ in pages]
                          + [(k, f"http://g.example/{k}", f"<p>some other words here w{k}</p>") for k in range(100, 200)],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.own_license for r in license_queries.op5(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k, _, _ in pages} == {k: name for k, _, name in pages} and sum(v is not None for v in got.values()) == 2
    assert spark.range(1).select(license_scan.html_lines(F.lit("<p>a <i>b</i>c<br/>d<pre>e</pre>"))).first()[0] == "\na bc\nd\ne\n"


# Classifier --------------------------------------------------------------------

def test_quality_classifier_accuracy(spark):
    from sightline.llm.classifier_queries import op3

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    aside = labels.where("doc_id % 4 = 1")
    model = quality_classifier.fit(docs, labels.where("doc_id % 4 <> 1"))
    judged = quality_classifier.score(docs, model).join(aside, "doc_id")
    n, right = judged.count(), judged.where("(quality = 1) = kept").count()
    assert right > 0.98 * n
    assert judged.where("quality = 1 AND NOT kept").count() <= 0.01 * n
    assert op3(spark, "/root/testdata/sf0.001").count() == 200


def test_metadata_classes_are_exact():
    lang = ["de", "es", "fr", None] * 10 + ["it"]
    classes = quality_classifier.Metadata.of(lang, ["a"] * len(lang))
    seen = classes.vectors([5] * 6, ["de", "es", "fr", None, "it", "xx"], ["a"] * 6)
    assert len({tuple(v) for v in seen[:5]}) == 5 and tuple(seen[4]) == tuple(seen[5])


def test_newton_sums_of_tasks_match_a_local_fit(spark):
    import numpy as np

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs.repartition(7), labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text", "n_chars", "lang", "source").orderBy("h").toArrow().to_pylist()
    parts = []
    for known in (True, False):
        own = [r for r in rows if (quality.get(r["doc_id"]) is not None) == known]
        text = quality_classifier._text_views(pa.array([r["text"] for r in own], pa.string())).astype(np.float64)
        parts.append((text, model.classes.vectors(*([r[c] for r in own] for c in ("n_chars", "lang", "source"))), own))
    (text, metadata, own), (pool_text, pool_metadata, others) = parts
    assert len(others) > 300
    y = np.array([float(quality[r["doc_id"]]) for r in own])
    calls = []
    want = quality_classifier.co_train(text, metadata, y, lambda work: calls.append(1) or work(pool_text, pool_metadata))
    assert len(calls) == quality_classifier.ROUNDS * (1 + quality_classifier.STEPS)
    for a, b in ((model.text, want.text), (model.metadata, want.metadata)):
        assert np.allclose(a.weights, b.weights, atol=1e-6)
    # What the views teach each other counts: without the pool the weights are others.
    alone = quality_classifier.co_train(text, metadata, y, lambda work: work(pool_text[:0], pool_metadata[:0]))
    assert not np.allclose(alone.metadata.weights, want.metadata.weights, atol=1e-3)


def test_quality_classifier_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_classifier.score(docs, quality_classifier.fit(docs, none))
    assert out.where("kept").count() == len(edge_rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, None), (7, 5), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.score(docs, quality_classifier.fit(docs, labels)).count() == len(edge_rows)
    assert quality_classifier.score(docs.limit(0), quality_classifier.fit(docs.limit(0), none)).count() == 0
