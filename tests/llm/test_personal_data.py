"""The semi-Markov model: segmentations against all of them, and spans beyond the patterns."""

import math
import random

import numpy as np
import pytest

from lehrplan.llm import pii

CUES = {"email": "write to", "phone": "call", "card": "visa", "ip": "server"}


def made(kind, draw):
    """A base span."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{draw.choice(['ann', 'j.doe', 'kim_7'])}@{draw.choice(['mail', 'x-y', 'post'])}.{draw.choice(['org', 'com'])}"
    if kind == "ip":
        return ".".join(str(draw.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"+{draw.randrange(1, 99)} ({number(3)}) {number(3)}-{number(4)}"
    body = "4" + number(14)
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def prose(draw, n=12):
    words = "the a of old green river sold 12 in 1999 for 300 items and 7 more 2024-01-30 3.5 later 10:45".split()
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    draw = random.Random(1)
    texts = []
    for i in range(240):
        kind = pii.KINDS[i % 4]
        cue = CUES[kind] if draw.random() < 0.5 else ""
        texts.append(f"{prose(draw)} {cue} {made(kind, draw)} {prose(draw)}")
    texts += [prose(draw, 40) for _ in range(60)]
    return pii.train(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_spans_beyond_the_patterns(trained):
    """Planted in other ways to write them: most are found whole and as their kind, and next to
    nothing else; what the patterns find stays."""
    draw = random.Random(2)
    planted = found = added = wrong = 0
    for i in range(400):
        kind = pii.KINDS[i % 4]
        span = draw.choice(pii.variants(kind, made(kind, draw)))
        head = f"{prose(draw)} {CUES[kind]} "
        text = f"{head}{span} {prose(draw)}"
        base, spans = pii.find(text, trained)
        if any(b[1] < len(head) + len(span) and b[2] > len(head) for b in base):
            continue  # the patterns see a part of it
        planted += 1
        found += (kind, len(head), len(head) + len(span)) in spans
        extra = [s for s in spans if s not in base]
        added += len(extra)
        wrong += sum(s[2] <= len(head) or s[1] >= len(head) + len(span) for s in extra)
        assert set(base) <= set(spans)
    assert planted > 300
    assert found / planted >= 0.8, (found, planted)
    assert wrong / added <= 0.02, (wrong, added)
    assert found / added >= 0.9, (found, added)


def test_named_variants(trained):
    for text, want in (("phone (555) 123-4567", ("phone", "(555) 123-4567")),
                       ("mail john [at] example.com", ("email", "john [at] example.com")),
                       ("card 4111.1111.1111.1111", ("card", "4111.1111.1111.1111"))):
        assert [(k, text[a:b]) for k, a, b in pii.find(text, trained)[1]] == [want]


def test_clean_texts_stay_clean(trained):
    """Rows of numbers that the patterns do not take for a card are taken for nothing."""
    draw = random.Random(3)
    for _ in range(300):
        base, spans = pii.find(prose(draw, 60), trained)
        assert spans == base


def segmentations(zone, at=0):
    """Every way to read a zone: atoms as nothing, or segments of a kind."""
    if at == zone.n:
        yield ()
        return
    yield from segmentations(zone, at + 1)
    for j, ends in zone.segments.items():
        for i, _, shared in ends:
            if i == at:
                for kind in pii.KINDS:
                    for rest in segmentations(zone, j):
                        yield ((i, j, kind, tuple(shared)), *rest)


def test_dynamic_programming():
    """Best segmentation, partition sum and marginals against all segmentations of small zones."""
    draw = random.Random(4)
    for text in ("1234 a", "12.34 5", "x 9.9.9.9", "a@b.cd", "(12) 345", "1 2 3 4", "12-34@a"):
        for zone in pii.zones(text):
            names = {n for ends in zone.segments.values() for _, _, shared in ends for n in shared}
            weights = {f"{k}|{n}": draw.gauss(0, 1) for k in pii.KINDS for n in sorted(names)}
            weights |= {k: draw.gauss(0, 1) for k in pii.KINDS}
            every = list(segmentations(zone))
            score = [sum(pii._score(weights, k, list(shared)) for _, _, k, shared in way) for way in every]
            total = math.log(sum(math.exp(s) for s in score))
            arcs, ahead, back = pii._lattice(zone, weights)
            assert ahead[-1] == pytest.approx(total) and back[0] == pytest.approx(total)
            for j, ends in arcs.items():
                for i, kind, s, _ in ends:
                    share = sum(math.exp(v - total) for way, v in zip(every, score)
                                if any(a[:3] == (i, j, kind) for a in way))
                    assert math.exp(ahead[i] + s + back[j] - ahead[-1]) == pytest.approx(share)
            best = every[int(np.argmax(score))]
            got = pii.model_spans(zone, weights, sure=0.0)
            assert sorted(got) == sorted((k, zone.start + zone.cuts[i], zone.start + zone.cuts[j])
                                         for i, j, k, _ in best)


def test_long_runs_are_not_cut(trained):
    """A span anywhere in a run that is longer than a zone is found."""
    draw = random.Random(5)
    for place in range(0, 90, 3):
        numbers = [str(draw.randrange(10, 99)) for _ in range(180)]
        text = " ".join(numbers[:place + 60]) + " call (555) 123-4567 " + " ".join(numbers[place + 60:])
        spans = [(k, text[a:b]) for k, a, b in pii.find(text, trained)[1]]
        assert len(pii.zones(text)) > 1
        assert any(k == "phone" and "123-4567" in s for k, s in spans), place


def test_variants_are_other_ways_to_write():
    draw = random.Random(6)
    for _ in range(200):
        for kind in pii.KINDS:
            span = made(kind, draw)
            assert [(k, span[a:b]) for k, a, b in pii.base_spans(span) if k == kind] == [(kind, span)]
            for other in pii.variants(kind, span):
                assert (kind, 0, len(other)) not in pii.base_spans(other)
                assert pii.possible(kind, other) or kind == "phone"
