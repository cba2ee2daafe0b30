"""Main text of HTML pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. A block's input is the sum of learned
vectors of its hashed tag-path tokens, the mean of learned vectors of its hashed
words, and a few figures. A bidirectional LSTM (numpy) reads the sequence and
every block is classified with the whole document as context. The blocks of the
article, joined by line feeds in page order, are the page's text.

The labeller is trained on made-up pages (``html_pages``) with a fixed seed, once
in a process, on the driver; its weights are of fixed size and travel to the
workers.

Defined results: null, empty and textless pages have an empty text; repeated
rows are extracted alike; pages are read to their end, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.html_blocks import Block, blocks
from netweave.llm.html_pages import DROP, KEEP, make_page

PATHS, WORDS, PATH_SIZE, WORD_SIZE, FIGURES, HIDDEN = 2048, 1024, 16, 4, 8, 16
TRAIN_PAGES, EPOCHS, BATCH = 1600, 5, 32
#: Blocks read at once, padding counted.
CELLS = 1 << 15
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(maxsize=1 << 16)
def _slot(token: str, size: int) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % size


def _inputs(page: Sequence[Block]) -> tuple[list[list[int]], list[list[int]], list[tuple]]:
    paths, words, figures = [], [], []
    for i, block in enumerate(page):
        own = block.text.split()
        size = len(block.text)
        paths.append([_slot(t, PATHS) for t in block.path] or [_slot("<body>", PATHS)])
        words.append([_slot(w.lower(), WORDS) for w in own] or [0])
        figures.append((
            math.log1p(len(own)) / 5, block.linked / max(size, 1), (i + 1) / len(page), 1 / (i + 1), min(len(page), 60) / 60,
            float(block.tag in _HEADINGS), float(block.tag == "p"), float(block.text[-1:] in ".!?"),
        ))
    return paths, words, figures


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)


def _sum_rows(table: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    starts = np.searchsorted(owner, np.arange(n))
    return np.add.reduceat(table[flat], starts, axis=0) if n else np.zeros((0, table.shape[1]), table.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = PATH_SIZE + WORD_SIZE + FIGURES
        self.p = {"path": r.normal(0, 0.3, (PATHS, PATH_SIZE)), "word": r.normal(0, 0.1, (WORDS, WORD_SIZE)), "out": r.normal(0, 0.2, (2 * HIDDEN + d, 1)), "out_b": np.zeros(1)}
        for way in "fb":
            self.p |= {f"w{way}": r.normal(0, 1 / math.sqrt(d), (d, 4 * HIDDEN)), f"u{way}": r.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), f"b{way}": np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _embed(self, pages: list[Sequence[Block]]) -> dict:
        paths, words, figures = [], [], []
        for page in pages:
            a, b, c = _inputs(page)
            paths += a
            words += b
            figures += c
        n = len(paths)
        (path, path_of), (word, word_of) = _ragged(paths), _ragged(words)
        share = (1 / np.bincount(word_of, minlength=n)).astype(np.float32)[:, None]
        x = np.concatenate((_sum_rows(self.p["path"], path, path_of, n), _sum_rows(self.p["word"], word, word_of, n) * share, np.array(figures, np.float32).reshape(n, FIGURES)), 1)
        sizes = np.array([len(p) for p in pages])
        column = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(len(pages)), sizes)
        return {"path": (path, path_of), "word": (word, word_of, share), "x": x, "row": row, "column": column, "back": np.repeat(sizes, sizes) - 1 - column, "steps": int(sizes.max(initial=0)), "pages": len(pages)}

    def _read(self, e: dict, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, HIDDEN) of one direction."""
        place = e["column"] if way == "f" else e["back"]
        gates = np.zeros((e["steps"], e["pages"], 4 * HIDDEN), np.float32)
        gates[place, e["row"]] = e["x"] @ self.p[f"w{way}"] + self.p[f"b{way}"]
        h = c = np.zeros((e["pages"], HIDDEN), np.float32)
        out, held = np.zeros((e["steps"], e["pages"], HIDDEN), np.float32), []
        for t in range(e["steps"]):
            a = gates[t] + h @ self.p[f"u{way}"]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            wide = np.tanh(c)
            h = o * wide
            out[t] = h
            if keep:
                held.append((i, f, o, g, wide, *before))
        return out, held

    def _forward(self, e: dict, keep: bool) -> tuple[np.ndarray, dict]:
        forward, held_f = self._read(e, "f", keep)
        backward, held_b = self._read(e, "b", keep)
        z = np.concatenate((forward[e["column"], e["row"]], backward[e["back"], e["row"]], e["x"]), 1)
        return _sigmoid((z @ self.p["out"] + self.p["out_b"])[:, 0]), {"z": z, "f": held_f, "b": held_b}

    def gradients(self, pages: list[Sequence[Block]], truth: np.ndarray) -> tuple[float, dict]:
        e = self._embed(pages)
        y, held = self._forward(e, True)
        error = ((y - truth) / len(truth))[:, None].astype(np.float32)
        g = {"out": held["z"].T @ error, "out_b": error.sum(0)}
        dz = error @ self.p["out"].T
        dx = dz[:, 2 * HIDDEN :].copy()
        for way, part, place in (("f", dz[:, :HIDDEN], e["column"]), ("b", dz[:, HIDDEN : 2 * HIDDEN], e["back"])):
            dh_all = np.zeros((e["steps"], e["pages"], HIDDEN), np.float32)
            dh_all[place, e["row"]] = part
            da_all = np.zeros((e["steps"], e["pages"], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"u{way}"])
            dh = dc = np.zeros((e["pages"], HIDDEN), np.float32)
            for t in range(e["steps"] - 1, -1, -1):
                i, f, o, new, wide, h0, c0 = held[way][t]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - wide * wide)
                da = np.concatenate((dc * new * i * (1 - i), dc * c0 * f * (1 - f), dh * wide * o * (1 - o), dc * i * (1 - new * new)), 1)
                da_all[t] = da
                du += h0.T @ da
                dh, dc = da @ self.p[f"u{way}"].T, dc * f
            da = da_all[place, e["row"]]
            g |= {f"w{way}": e["x"].T @ da, f"b{way}": da.sum(0), f"u{way}": du}
            dx += da @ self.p[f"w{way}"].T
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        path, path_of = e["path"]
        np.add.at(g["path"], path, dx[path_of, :PATH_SIZE])
        word, word_of, share = e["word"]
        np.add.at(g["word"], word, (dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] * share)[word_of])
        loss = -float(np.mean(truth * np.log(y + 1e-7) + (1 - truth) * np.log(1 - y + 1e-7)))
        return loss, g

    def probabilities(self, pages: list[Sequence[Block]]) -> list[np.ndarray]:
        """For each page the probabilities that its blocks are main text. Pages
        of about one length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= CELLS:
                end += 1
            part = order[at:end]
            y, _ = self._forward(self._embed([pages[i] for i in part]), False)
            for i, own in zip(part, np.split(y, np.cumsum([len(pages[i]) for i in part])[:-1]), strict=True):
                out[i] = own
            at = end
        return out


def marked(html: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a made-up page without their marks, and the truth."""
    page, truth = [], []
    for block in blocks(html):
        keep = KEEP in block.text
        if text := " ".join(block.text.replace(KEEP, "").replace(DROP, "").split()):
            page.append(Block(text, block.path, block.linked, block.tag))
            truth.append(keep)
    return page, np.array(truth, np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """The labeller after training on that many made-up pages (Adam)."""
    model, r = Labeller(seed), np.random.default_rng(seed)
    data = sorted((p for p in (marked(make_page(i)) for i in range(pages)) if p[0]), key=lambda p: len(p[0]))
    groups = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, total = 0, epochs * len(groups)
    for _ in range(epochs):
        for i in r.permutation(len(groups)):
            step += 1
            _, g = model.gradients([p for p, _ in groups[i]], np.concatenate([t for _, t in groups[i]]))
            rate = 0.02 * (1 - (step - 1) / total) + 1e-4
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(html) for html in pages]
    return ["\n".join(b.text for b, p in zip(page, y, strict=True) if p >= 0.5) for page, y in zip(found, model.probabilities(found), strict=True)]


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str, model: Labeller | None = None) -> DataFrame:
    """(id, url, text, n_chars) of each row; nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(model or trained())
    rows = df.select(id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(sent.value, [html or "" for html in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
