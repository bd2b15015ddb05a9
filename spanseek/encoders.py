"""Encoders turn a text column into a vector column. All share one method, so plans do not care which one they get."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanseek import fixed_values as fv
from spanseek.functions import vectors as vx
from spanseek.models import MODELS, Model, fingerprint


KNOWN_WORDS = 20_000  # slots of words that a task remembers


class Encoder(Protocol):
    model: Model

    def embed(self, text: Column, role: str) -> Column: ...


class GramEncoder:
    """Counts of given character grams, plus a small constant, L2-normalised. Needs no model."""

    def __init__(self, grams: list[str], model: Model | None = None, floor: float = 1e-3) -> None:
        self.grams, self.floor = grams, floor
        self.model = model or Model("gram", "local/gram", str(len(grams)), "", "")

    def embed(self, text: Column, role: str) -> Column:
        self.model.prompt(role)
        grams, floor = list(self.grams), self.floor

        @F.pandas_udf("array<float>")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            missing, count = [None] * len(grams), _gram_counter(grams)
            for texts in batches:  # lower-cased by Spark
                given = texts.notna().to_numpy()
                counts = np.array([count(t) for t in texts[given]], "float64").reshape(-1, len(grams))
                raw = (counts + floor).astype("float32").astype("float64")
                norms = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])  # one after the other, as the column functions add
                rows = iter((raw / np.maximum(norms, fv.CLIP_NORM)).astype("float32"))
                yield pd.Series([next(rows) if x else missing for x in given], dtype=object)

        return counted(F.lower(text))


def _gram_counter(grams: list[str]) -> Callable[[str], np.ndarray]:
    """How often each gram stands in a text, copies that overlap counted as ``str.count`` does. Two ASCII letters are looked up by their bytes, all grams of
    that size in one pass; what can overlap itself, or is longer, is searched for."""
    single = [i for i, g in enumerate(grams) if len(g) == 1 and g.isascii()]
    double = [i for i, g in enumerate(grams) if len(g) == 2 and g.isascii() and g[0] != g[1]]
    other = [i for i in range(len(grams)) if i not in {*single, *double}]
    letters = np.array([ord(grams[i]) for i in single], "int64")
    classes = {g: n + 1 for n, g in enumerate(dict.fromkeys(grams[i] for i in double))}
    table = np.zeros(1 << 16, "uint8" if len(classes) < 255 else "int64")
    for g, n in classes.items():
        table[ord(g[0]) << 8 | ord(g[1])] = n
    place = np.array([classes[grams[i]] for i in double], "int64")

    def count(text: str) -> np.ndarray:
        out, b = np.zeros(len(grams)), np.frombuffer(text.encode(errors="surrogatepass"), "uint8")
        if len(single):
            out[single] = np.bincount(b, minlength=256)[letters]
        if len(double) and len(b) > 1:
            out[double] = np.bincount(table[b[:-1].astype("uint16") << 8 | b[1:]], minlength=len(classes) + 1)[place]
        for i in other:
            out[i] = text.count(grams[i])
        return out

    return count


class HashingEncoder:
    """Word counts hashed into ``dim`` slots; deterministic, so tests need no model."""

    def __init__(self, dim: int = 64, salt: str = "", model: Model | None = None) -> None:
        self.dim, self.salt = dim, salt
        self.model = model or Model("hash", "local/hash", f"{dim}{salt}", "", "")

    def embed(self, text: Column, role: str) -> Column:
        self.model.prompt(role)
        dim, salt = self.dim, self.salt
        word = re.compile("[a-z]+")

        @F.pandas_udf("array<float>")
        def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            slots: dict[str, int] = {}
            for texts in batches:
                out = np.empty(len(texts), object)
                for i, t in enumerate(texts):
                    found = word.findall(t.lower())
                    at = [slots[w] if w in slots else slots.setdefault(w, zlib.crc32((salt + w).encode()) % dim) for w in found]
                    if len(slots) > KNOWN_WORDS:  # what a task remembers does not grow with the vocabulary
                        slots.clear()
                    counts = np.bincount(np.asarray(at, dtype="int64"), minlength=dim)
                    v = counts + 1e-3
                    out[i] = (v / np.linalg.norm(v)).astype("float32")
                yield pd.Series(out)

        return hashed(text)


class TransformerEncoder:
    """A sentence-transformers model in fp32, loaded once per task. Needs that optional package on the workers."""

    def __init__(self, model: Model, device: str = "cpu", batch_size: int = 16) -> None:
        self.model, self.device, self.batch_size = model, device, batch_size

    def embed(self, text: Column, role: str) -> Column:
        model, device, batch_size, prompt = self.model, self.device, self.batch_size, self.model.prompt(role)

        @F.pandas_udf("array<float>")
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            try:
                import torch
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("TransformerEncoder needs torch and sentence-transformers on every worker") from e
            net = SentenceTransformer(model.hf_id, revision=model.revision, device=device, trust_remote_code=True,
                                      model_kwargs={"dtype": torch.float32})
            net.max_seq_length = model.max_seq_length
            for texts in batches:
                v = net.encode([prompt + t for t in texts], batch_size=batch_size, convert_to_numpy=True,
                               normalize_embeddings=False, show_progress_bar=False)
                yield pd.Series(list((v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")))

        return encoded(text)


Hook = Callable[[Column, str], Column]


def same_text(text: Column, role: str) -> Column:
    return text


def unit_vectors(vector: Column, role: str) -> Column:
    return vx.l2_normalise_clipped(vector)


class HookedEncoder:
    """An encoder with a text hook before it and a vector hook after it, both aware of the role."""

    def __init__(self, encoder: Encoder, before: Hook = same_text, after: Hook = unit_vectors) -> None:
        self.encoder, self.before, self.after, self.model = encoder, before, after, encoder.model

    def embed(self, text: Column, role: str) -> Column:
        return self.after(self.encoder.embed(self.before(text, role), role), role)


def role_of(prompt_type: str | None) -> str:
    """Only an explicit query prompt is a query; anything else is a document."""
    return "query" if prompt_type == "query" else "document"


def with_vector(df: DataFrame, encoder: Encoder, text: str, role: str, name: str = "vector") -> DataFrame:
    return df.withColumn(name, encoder.embed(F.col(text), role))


def encoder_of_index(meta) -> Encoder:
    """The encoder that an index says it was built with (a row of INDEX_META). Scoring it with another one of the same dimension would give
    numbers without meaning, so an index whose model or settings are not known is refused."""
    hashed = re.fullmatch(r"(\d+)(.*)", meta["revision"] or "") if meta["model"] == "local/hash" else None
    if hashed:
        encoder = HashingEncoder(int(hashed[1]), hashed[2])
    else:
        known = [m for m in MODELS.values() if (m.hf_id, m.revision) == (meta["model"], meta["revision"])]
        if not known:
            raise ValueError(f"the index was built with {meta['model']} at {meta['revision']}, which is not a known model")
        encoder = TransformerEncoder(known[0])
    if fingerprint(encoder.model, kind="document", precision="fp32") != meta["fingerprint"]:
        raise ValueError(f"the index was built with other settings of {meta['model']}")
    return encoder
