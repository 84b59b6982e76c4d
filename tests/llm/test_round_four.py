"""What the findings of round two asked for after its last changes."""

import re
import time
from pathlib import Path

import numpy as np

from tesserae.llm import lm_scoring
from tesserae.llm.common import staged
from tesserae.llm.lm_scoring import BATCH, CLASSES, SIDE, SIZE, VOCABULARY


def test_staging_hands_back_what_the_driver_has_freed(spark):
    """Memory that the JVM frees outside its heap, as its compilers do, is not kept by malloc."""
    jvm = spark._jvm
    smaps = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", smaps.read_text())[1]) / 1024
    staged(spark.range(10), "few")  # so that classes are there
    made = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for one in made:
        one.setInput(bytes(50_000))
        one.deflate(bytes(64))
    full = held()
    for one in made[:-1]:  # the last keeps malloc from cutting its end off
        one.end()
    staged(spark.range(10), "few")
    after = held()
    made[-1].end()
    assert after < full - 150, (full, after)


def plain_step(net, around, words):
    """The step of ``Network`` word by word: each of the ids around a word by itself, each class by itself."""
    n = len(words)
    there = around != VOCABULARY
    share = np.hstack([there[:, half] / np.maximum(1, there[:, half].sum(axis=1, keepdims=True)) for half in (slice(0, SIDE), slice(SIDE, None))]).astype(np.float32)
    seen = net.e[around] * share[:, :, None]
    x, h = net.hidden(seen[:, :SIDE].sum(axis=1), seen[:, SIDE:].sum(axis=1))
    cls, inside = words // CLASSES, words % CLASSES

    def softmax(x):
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    d = softmax(h @ net.c + net.cb)
    d[np.arange(n), cls] -= 1
    d /= n
    dh = d @ net.c.T
    grads = {"c": h.T @ d, "cb": d.sum(axis=0)}
    for k in np.unique(cls):
        rows = np.flatnonzero(cls == k)
        d = softmax(h[rows] @ net.o[k] + net.ob[k])
        d[np.arange(len(rows)), inside[rows]] -= 1
        d /= n
        dh[rows] += d @ net.o[k].T
        net._move("o", h[rows].T @ d, k)
        net._move("ob", d.sum(axis=0), k)
    dz = dh * (1 - h * h)
    grads |= {"a": x.T @ dz, "b": dz.sum(axis=0)}
    dx = dz @ net.a.T
    for name, grad in grads.items():
        net._move(name, grad, slice(None))
    spread = np.hstack([np.repeat(dx[:, None, :SIZE], SIDE, axis=1), np.repeat(dx[:, None, SIZE:], SIDE, axis=1)]) * share[:, :, None]
    order = np.argsort(around, axis=None, kind="stable")
    flat = around.reshape(-1)[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    ids, total = flat[first], np.add.reduceat(spread.reshape(-1, SIZE)[order], first, axis=0)
    net.squares["e"][ids] += (total**2).mean(axis=1, keepdims=True)
    net.e[ids] -= lm_scoring.RATE * total / np.sqrt(net.squares["e"][ids])
    net.e[VOCABULARY] = 0


def test_training_makes_the_plain_steps_in_less_time():
    """Steps on a line are those word by word, whatever parts the line is cut into, in under three quarters of their time."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 500, 120)
    words = (VOCABULARY * rng.random(sizes.sum()) ** 3).astype(np.int32)
    line, at = lm_scoring.padded_line(words, sizes)
    assert line[at].tolist() == words.tolist()
    at = np.sort(rng.choice(at, 5 * BATCH, replace=False))
    around = line[at[:, None] + np.r_[-SIDE:0, 1 : SIDE + 1]]
    ours, plain, took = lm_scoring.Network(), lm_scoring.Network(), [[], []]
    for k in range(0, len(at), BATCH):
        began = time.thread_time()
        ours.step(*lm_scoring._cut(line, at[k : k + BATCH]))
        between = time.thread_time()
        plain_step(plain, around[k : k + BATCH], line[at[k : k + BATCH]])
        took[0].append(between - began)
        took[1].append(time.thread_time() - between)
    assert np.abs(ours.flat - plain.flat).max() < 1e-3
    assert min(took[0]) < 0.75 * min(took[1])


def test_words_are_those_of_split():
    texts = [b"", b"  ", b"\xff A \x85b\x1c", b" a  B\x0b\x0cc \n", "Ä ä\u00a0B".encode(), b"a a rare"]
    words, codes, sizes = lm_scoring.tokens(texts)
    want = [w for t in texts for w in t.lower().split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and [words[k] for k in codes] == want
    assert len(set(words)) == len(words) and lm_scoring.tokens([b""])[2].tolist() == [0]
    ids = lm_scoring.Words({b"a": 0}).of([b"a", b"rare"])
    assert ids.tolist() == [0, VOCABULARY - lm_scoring.BUCKETS + lm_scoring.crc32(b"rare") % lm_scoring.BUCKETS]
