"""Predictions of the language and quality models against the averages and the softmax done plainly, gram by gram."""

import math
import random

import numpy as np
import pyarrow as pa

from sparkwell.llm import language, quality


def gram_bucket(gram, bits):
    """Bucket of a run of bytes, in whole numbers of Python."""
    h = 0
    for b in gram:
        h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
    h = ((h ^ (h >> 15) ^ (len(gram) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
    return h >> (32 - bits)


def grams(data, sizes):
    return [data[i : i + n] for n in sizes for i in range(len(data) - n + 1)]


def plain_softmax(z, factor):
    e = [math.exp(x * factor - max(z) * factor) for x in z]
    return [x / sum(e) for x in e]


def letters(text):
    """Bytes of letters, lower-cased; what stands between them is one zero."""
    out = bytearray()
    for b in text.lower().encode():
        if 97 <= b <= 122 or b >= 128:
            out.append(b)
        elif out and out[-1]:
            out.append(0)
    return bytes(out)


def test_language_scores_done_plainly():
    rng = random.Random(2)
    words = {"en": "the of and water house tree".split(), "de": "der und wasser häuser bäume für".split(), "fr": "le et eau maison arbre été".split()}
    texts = [(" ".join(rng.choice(w) for _ in range(rng.randint(3, 15))), lang) for lang, w in words.items() for _ in range(40)]
    model = language.fit([t for t, _ in texts], [x for _, x in texts])
    asked = [t for t, _ in texts[::9]] + ["Das WASSER, die Häuser! 123 für", "été", "a", "12 3", " leading and  double"]
    best, score = model.predict(pa.array(asked))
    for t, b, s in zip(asked, best.tolist(), score.tolist(), strict=True):
        rows = [model.table[gram_bucket(g, language.BITS)].astype(float) for g in grams(letters(t), language.GRAMS)]
        p = plain_softmax([sum(r[k] for r in rows) / max(1, len(rows)) for k in range(3)], model.factor)
        assert abs(p[b] - s) < 1e-6 and abs(max(p) - s) < 1e-6, t
    assert [model.langs[b] for b in best[: len(texts[::9])]] == [x for _, x in texts[::9]]


def test_quality_scores_done_plainly():
    rng = random.Random(3)
    good = [" ".join(rng.choice("clear sentences about the river and its banks".split()) for _ in range(20)) for _ in range(40)]
    bad = [" ".join(rng.choice("buy buy now!!! click click".split()) for _ in range(20)) for _ in range(40)]
    model = quality.fit(good + bad, [1] * 40 + [0] * 40)

    def buckets(text, batch):
        """Of one kind of feature, as the model itself makes them of a text of one or two words."""
        ((_, _, made),) = quality.features(pa.array([text]))
        return made[batch][0].tolist()

    for t in [good[0], bad[0], "river", "buy click river", "the\nriver  and\tits"]:
        w = t.split()
        ids = [buckets(x, 0)[0] for x in w]
        ids += [k for k in range(1, quality.BACK + 1) for i in range(k, len(w)) if w[i] == w[i - k]]
        ids += [buckets(f"{a} {b}", quality.BACK + 1)[0] for a, b in zip(w, w[1:])]
        data = bytes(32 if 9 <= b <= 13 else b for b in t.encode())
        ids += [gram_bucket(g, quality.BITS) for g in grams(data, quality.CHARS)]
        rows = [model.table[k].astype(float) for k in ids]
        p = plain_softmax([sum(r[k] for r in rows) / len(rows) for k in range(2)], model.factor)
        assert abs(p[1] - model.score(pa.array([t]))[0]) < 1e-6, t
    scores = model.score(pa.array(good + bad))
    assert (scores[:40] > 0.5).all() and (scores[40:] < 0.5).all() and np.isclose(model.score(pa.array(["", None])), 0.5).all()
