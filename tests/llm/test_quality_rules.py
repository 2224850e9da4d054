from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paralens.llm import quality_rules as q
from paralens.llm import ragged

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in t), t.count("\n") + 1, len(lines) - len(set(lines)), len(hit)


def test_measures_equal_brute_force(docs, texts):
    found = {r.doc_id: tuple(r[m] for m in q.MEASURES) for r in q.measure(docs).collect()}
    assert [found[k] for k in range(len(texts))] == [brute(t) for t in texts]


@pytest.mark.parametrize("collide", [False, True])
def test_lines_and_windows_are_told_apart_by_bytes(thue_morse, collide, monkeypatch):
    if collide:
        monkeypatch.setattr(ragged.Hashes, "of", lambda self, a, b: np.full(len(a), 7, np.uint64))
    a, b = thue_morse
    texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([a, b] * 6), " ".join([a] * 7 + [b]), "", "x y z", f"{a} x x x x {b} x x x x", *("one two three four five six one two three four five",) * 2]
    assert list(zip(*(x.tolist() for x in q._block(*ragged.flat(pa.array(texts)))), strict=True)) == [brute(t) for t in texts]


def test_bits_policies_and_ablations(docs):
    stored = q.ledger(q.measure(docs)).cache()
    rows = stored.collect()
    for r in rows:
        assert bool(r.fail_bits & 1) == (r.n_words < 10) and bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 20 * r.n_words)
    for policy in q.POLICIES:
        m = q.mask(policy)
        assert stored.where(q.passes(policy)).count() == sum(r.fail_bits & m == 0 for r in rows)
    cells = {(r.policy, r["rule"]): r for r in q.ablations(stored).collect()}
    for policy in q.POLICIES:
        m = q.mask(policy)
        for rule in q.RULES:
            if rule.name in policy.rules:
                c, bit = cells[policy.version, rule.name], 1 << rule.bit
                assert c.n_failed == sum(bool(r.fail_bits & bit) for r in rows) and c.n_failed_alone == sum(r.fail_bits & m == bit for r in rows)
                assert c.n_kept_without == sum(r.fail_bits & m & ~bit == 0 for r in rows)


def test_odd_rows(odd, none):
    rows = q.ledger(q.measure(odd)).collect()
    assert len(rows) == odd.count() and sum(r.n_words == 60_000 for r in rows) == 2 and sum(r.n_words == 0 for r in rows) == 4
    assert q.ledger(q.measure(none)).count() == 0 and q.ablations(q.ledger(q.measure(none))).count() == 0
