import brute
import numpy as np
from conftest import prose
from test_similar import likeness

from tallymill.llm.similar import keep_one


def edited(text, edits, rng):
    w = text.split()
    for k in rng.choice(len(w), edits, replace=False):
        w[k] = f"new{rng.integers(10**9)}"
    return " ".join(w)


def whole(rows):
    """The smallest id of each component of all links."""
    low = {i: i for i, _ in rows}
    code = {i: brute.fingerprint(t) for i, t in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, t in rows:
        for j, u in rows:
            if j < i and ((code[i] ^ code[j]).bit_count() <= 3 or likeness(t, u) >= 0.8):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i for i in low if find(i) == i}


def test_kept_are_those_of_all_links(spark):
    """Chains of edits, whose middle texts are linked to both sides, and pages of one template, near a leader that is no copy."""
    rng, texts = np.random.default_rng(8), []
    for c in range(6):
        texts.append(prose(900 + c, 160))
        for _ in range(9):
            texts.append(edited(texts[-1], 3, rng))
    template = prose(990, 300)
    for _ in range(20):
        page = edited(template, 14, rng)
        texts += [page, edited(page, 5, rng)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    kept = [r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == whole(rows)
