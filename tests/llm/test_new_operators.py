"""Tokenizer alignment, personal data and filter audit against brute force, and their edge cases."""

from __future__ import annotations

import bisect
import collections
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import alignment_queries, filter_audit, personal_data, pii_labelers, token_alignment
from sightline.llm.packing import vocabulary_file
from sightline.llm.queries import LLM_QUERIES
from tests.llm.test_operators import documents, sentence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and ids, odd characters."""
    rng = random.Random(5)
    return [
        (1, "one two three four", "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t ", "en", None),
        (None, "text without an id", "en", "a"), (6, sentence(rng, 12_000), "en", "a"), (7, "twice the same row", "en", "b"),
        (7, "twice the same row", "en", "b"), (8, "same id, first text", "en", "b"), (8, "same id, other text", "en", "b"),
        (9, "a▁b shows the mark itself", "de", "b"), (10, "naïve café — été 漢字 🙂 <|endoftext|> <s> <0x41>", "fr", "b"),
        (11, "  double  spaces   and\nlines\t\x00\x0b", "en", "b"), (12, "x" * 3_000, "en", "c"), (13, "twice the same row", "en", "c")]


# Tokenizer alignment -------------------------------------------------------------

@functools.cache
def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_file("piece_bpe_32k.model"))


def _tokens(text):
    """(id, bytes) of both sides, straight from the libraries."""
    a, b = _libraries()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in plain)}
    if not text:
        return [], []
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
             for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def _spans(tokens):
    ends = list(itertools.accumulate(len(b) for _, b in tokens))
    return [(i, e - len(b), e) for (i, b), e in zip(tokens, ends)]


def _brute_alignment(rows):
    held, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = map(_spans, _tokens(text))
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([], []) for _ in common]
        for side, tokens in enumerate((a, b)):
            for i, _, e in tokens:
                groups[bisect.bisect_left(common, e)][side].append(i)
        links, first = [], 0
        for i, s, e in a:
            while b[first][2] <= s:
                first += 1
            links += [(i, j) for j, s2, e2 in itertools.takewhile(lambda x: x[1] < e, b[first:first + 400]) if e2 > s]
        counts.update(links)
        held.append((doc_id, len(a), len(b), len(common), links, groups))
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, groups in held:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), text if not text else hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _same_rows(got, expected):
    got = sorted((tuple(r) for r in got), key=repr)
    assert got == expected


@pytest.mark.parametrize("broadcast_pairs", [10**6, 0])
def test_alignment_matches_brute_force(spark, edge_rows, broadcast_pairs):
    df = documents(spark, edge_rows).repartition(3)
    got = alignment_queries.aligned_digests(df, broadcast_pairs=broadcast_pairs)
    _same_rows(got.collect(), _brute_alignment([(i, t) for i, t, *_ in edge_rows]))


def test_alignment_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op11_tokenizer_alignment"].run(spark, SF).collect()
    expected = _brute_alignment(rows)
    _same_rows(got, expected)
    assert sum(r[4] for r in expected) > 10_000


def test_alignment_of_long_texts_in_parts(spark, monkeypatch):
    """Cutting a text into parts changes nothing."""
    text = sentence(random.Random(9), 2_000)
    parts = token_alignment.text_parts(text, 100)
    assert len(parts) > 50 and "".join(parts) == text
    first, second = token_alignment.tokenizers_of(vocabulary_file(), vocabulary_file("piece_bpe_32k.model"))
    cut = token_alignment.text_parts(" " + text, 100)
    assert first.encode(" " + text).tolist() == np.concatenate([first.encode(p) for p in cut]).tolist()
    assert second.encode([" " + text])[0].tolist() == np.concatenate(second.encode(cut)).tolist()
    assert token_alignment.text_parts("x" * 500, 100) == ["x" * 500]


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align_tokenizers(documents(spark, [])).count() == 0
    only_empty = token_alignment.align_tokenizers(documents(spark, [(1, None, "en", "a"), (2, "", "en", "a")])).collect()
    assert [(r.n_a, r.n_links, bytes(r.steps), r.count_sum) for r in only_empty] == [(0, 0, b"", 0)] * 2


# Personal data -------------------------------------------------------------------

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _brute_base(text):
    out = []
    for kind, pattern in _PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": lambda: True, "ip": lambda: max(map(int, m.group().split("."))) <= 255,
                "card": lambda: 13 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if good():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    parts = ["1", "9", "25", ".", ".", "@", "a", "b.", "-", " ", "+", "(", ")", "%", "é", "_", "4111 1111-1111 1111", "1.2.3.4",
             "x@y.z", "+1 (234) 555-1234", "256.1.1.1", "0000000000000000"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [f"{s.kind}:{s.start}:{s.end}" for s in pii_labelers.base_spans(text)] == _brute_base(text)
    for long in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii_labelers.base_spans(long)


PEOPLE = [
    "Dear Mr. Peter Schneider, call 555-123-4567 or write to anna at example dot org.",
    "His phone is (212) 555-0199, born 12/05/1981 in Paris.", "Her SSN is 123-45-6789 and she lives at 12 Oak Street today.",
    'The config has password = "hunter2hunter2Xy9" in it.', "Wire it to IBAN DE89 3704 0044 0532 0130 00 please.",
    "Card 4111 1111 1111 1111 expires soon, mail bob@example.com from 10.0.0.7, phone +1 (415) 555-2671."]
CLEAN = [
    "Version 10.2.3 was built in step 4 of 12, see figure 7.", "The price is 1,234.50 usd for 16 items.",
    "Order number 1234567890123456 shipped.", "Peter said nothing; mark the dot at the end of the street."]


def test_added_spans(spark):
    rows = [(i, t + f" Text {i}.", "en", "a") for i, t in enumerate((PEOPLE + CLEAN) * 20)]
    found = {}
    for r in personal_data.find_personal_data(documents(spark, rows)).collect():
        text = rows[r.doc_id][1]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.base] == _brute_base(text)
        assert {(s.kind, s.start, s.end) for s in r.base} <= {(s.kind, s.start, s.end) for s in r.spans}
        order = [(pii_labelers.KINDS.index(s.kind), s.start) for s in r.spans]
        assert order == sorted(order)
        taken = sorted((s.start, s.end) for s in r.spans if s not in r.base)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        found.setdefault(r.doc_id % 10, set()).add(tuple((s.kind, text[s.start:s.end]) for s in r.spans))
    assert all(len(v) == 1 for v in found.values())
    found = {k: set(next(iter(v))) for k, v in found.items()}
    assert {("name", "Peter Schneider"), ("phone", "555-123-4567"), ("email", "anna at example dot org")} <= found[0]
    assert {("phone", "(212) 555-0199"), ("birth", "12/05/1981")} <= found[1]
    assert {("identity", "123-45-6789"), ("address", "12 Oak Street")} <= found[2]
    assert ("secret", "hunter2hunter2Xy9") in found[3]
    assert ("identity", "DE89 3704 0044 0532 0130 00") in found[4]
    assert not any(found[k] for k in range(6, 10)), found


def test_reliabilities_are_estimated():
    """Votes drawn from known reliabilities: posteriors separate the classes, at any number of documents alike."""
    rng = np.random.default_rng(4)
    accuracy = np.array([0.95, 0.8, 0.85, 0.6, 0.75])
    truth = rng.random(20_000) < 0.4
    right, silent = rng.random((20_000, 5)) < accuracy, rng.random((20_000, 5)) < 0.4
    votes = np.where(silent, 0, np.where(right == truth[:, None], 1, -1))
    patterns = [personal_data.pattern_of(tuple(v)) for v in votes.tolist()]
    assert [v - 1 for v in personal_data.votes_of(patterns[0])] == votes[0].tolist()
    counts = collections.Counter(patterns)
    labels, shares, share = personal_data.estimate_reliabilities(counts)
    guessed = np.array([labels[p] for p in patterns]) >= 0.5
    majority = votes.sum(axis=1) > 0
    best = votes @ np.log(accuracy / (1 - accuracy)) + np.log(0.4 / 0.6) > 0
    assert (guessed == truth).mean() > (majority == truth).mean() + 0.01
    assert (guessed == truth).mean() > (best == truth).mean() - 0.01
    assert abs(share - 0.4) < 0.1 and shares[1, 0, 2] > shares[1, 3, 2]
    more, _, _ = personal_data.estimate_reliabilities({p: 1_000 * n for p, n in counts.items()})
    assert all(abs(more[p] - labels[p]) < 1e-9 for p in labels)


def test_classifier_learns_the_labels_and_ignores_partitions(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate((PEOPLE + CLEAN) * 5)]
    found = personal_data.candidate_spans(documents(spark, rows))
    labels, _ = personal_data.label_patterns(found)
    one = personal_data.train_classifier(found.repartition(1), labels)
    many = personal_data.train_classifier(found.repartition(7), labels)
    assert np.array_equal(one, many) and np.abs(one).max() > 0.1


def test_personal_data_edges(spark, edge_rows):
    rows = [*edge_rows, (20, "reach me: é" * 4_000 + " x@y.zz", "en", "a"), (21, None, None, None)]
    got = personal_data.find_personal_data(documents(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
    assert next(r for r in got if r.doc_id == 20).base[0].start == 44_001
    assert personal_data.find_personal_data(documents(spark, [])).count() == 0
    assert [r.spans for r in personal_data.find_personal_data(documents(spark, [(1, "no such thing", "en", "a")])).collect()] == [[]]


def test_personal_query_matches_brute_force(spark):
    texts = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        texts[r.doc_id].append(_brute_base(r.text))
    got = LLM_QUERIES["op12_personal_data"].run(spark, SF).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        match = [b for b in texts[r.doc_id] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256]
        assert match and set(match[0]) <= set(r.spans.split(",")) | {""}
        kinds = collections.Counter(s.split(":")[0] for s in match[0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in pii_labelers.BASE_KINDS]


# Filter audit --------------------------------------------------------------------

def test_adjacent_swaps_visit_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for at in filter_audit.adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def _brute_part(counts, letters):
    """All orders by walking the masks."""
    out, shapley = {}, collections.Counter()
    bit = {c: 1 << i for i, c in enumerate(letters)}
    for order in itertools.permutations(letters):
        before = 0
        for step, name in enumerate(order, 1):
            def total(keep, k=0):
                return sum(v[k] for m, v in counts.items() if keep(m))
            removed = [total(lambda m: m & bit[name] and not m & before, k) for k in range(3)]
            shapley[name] += removed[0]
            out["".join(order), step] = [
                total(lambda m: not m & (before | bit[name])), removed[0], total(lambda m: m & bit[name] and m & before),
                total(lambda m: m == bit[name]), removed[1], removed[2]]
            before |= bit[name]
    return {k: (*v, shapley[k[0][k[1] - 1]]) for k, v in out.items()}


def test_diagram_matches_brute_force():
    rng = random.Random(8)
    for n in (1, 2, 4, 5):
        letters = "ABCDE"[:n]
        for share in (0.0, 0.3, 1.0):
            counts = {m: (rng.randrange(4), rng.randrange(2), rng.randrange(2)) for m in range(1 << n) if rng.random() < share}
            got = {(o, s): tuple(v) for o, s, *v in filter_audit.audit_part(counts, letters)}
            assert got == _brute_part(counts, letters)


def test_diagram_shares_equal_nodes():
    diagram = filter_audit.Diagram("ABCDE", {})
    assert [len(level) for level in diagram.levels] == [1] * 5
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
    assert [len(level) for level in diagram.levels] == [1] * 5


def test_audit_edges(spark, edge_rows):
    """Counts of every part against Python, with repeated rows, null ids, null parts and several label rows."""
    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (1, 0, 1, "x"), (7, 1, 1, "x"), (8, None, 1, "x"), (13, 1, None, "x"), (None, 1, 1, "x")],
        "doc_id long, quality int, toxic int, part string")
    good, toxic = {1, 7, 13}, {1, 7, 8}
    rows = [*edge_rows, (14, "LOUD " * 60, "en", "c"), (15, "a # b", "en", ""), (5, "x" * 3_000, "en", "a"), (None, "", "en", "c")]
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0]))
    for i, text, _, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words))
        mask += 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + 8 * bool(re.search("[#$%&*|]", text))
        mask += 16 * (i is not None and i > least[text])
        cell = parts[part or ""][mask]
        for k, hit in enumerate((True, i in good, i in toxic)):
            cell[k] += hit
    expected = {(p, *k): v for p, counts in parts.items() for k, v in _brute_part(counts, "ABCDE").items()}
    got = filter_audit.audit_filters(documents(spark, rows), labels).collect()
    assert len(got) == 600 * len(parts)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == expected
    assert filter_audit.audit_filters(documents(spark, []), labels).count() == 0
    assert filter_audit.audit_filters(documents(spark, rows[:2]), labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
