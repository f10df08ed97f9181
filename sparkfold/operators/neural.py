"""Learned codecs behind one lossless wrapper, and where their weights are looked for. No weights come with this library.

A subclass says how an image becomes a latent form and an approximation of it again; the
wrapper keeps the differences, so every image comes back as it was.
"""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import zstandard

from . import raster, residuals

#: Environment variable that names a folder of models, looked at before the others.
MODELS = "SPARKFOLD_MODELS"


class ModelMissing(RuntimeError):
    """The weights of a domain aren't there."""


def search_paths() -> list[Path]:
    named = os.environ.get(MODELS)
    return [*([Path(named)] if named else []), Path.home() / ".sparkfold" / "models", Path("models")]


def find_model(domain: str, role: str, folders: Sequence[Path] | None = None) -> Path | None:
    """``<domain>_<role>.onnx`` in the first folder that has it; role is encoder or decoder."""
    return next((p for f in (search_paths() if folders is None else folders) if (p := Path(f) / f"{domain}_{role}.onnx").is_file()), None)


def models_available(domain: str, folders: Sequence[Path] | None = None) -> bool:
    return all(find_model(domain, role, folders) for role in ("encoder", "decoder"))


class NeuralCodec(ABC):
    """Six hooks of a domain's codec; compress and decompress aren't theirs to change."""

    def __init__(self, domain: str):
        if domain not in residuals.CODECS:
            raise ValueError(f"no domain {domain}; there are {', '.join(sorted(residuals.CODECS))}")
        self.domain, self._loaded = domain, False
        self.name, self.estimate = f"neural_{domain}", residuals.CODECS[domain][2]

    @abstractmethod
    def load(self) -> None: ...

    @abstractmethod
    def encode(self, image: np.ndarray) -> object: ...

    @abstractmethod
    def decode(self, latent: object) -> np.ndarray: ...

    @abstractmethod
    def to_bytes(self, latent: object) -> bytes: ...

    @abstractmethod
    def from_bytes(self, data: bytes) -> object: ...

    @abstractmethod
    def version(self) -> str: ...

    def applies(self, domain: str, confidence: float) -> bool:
        return residuals.applies(domain, confidence, self.domain)

    def _ready(self) -> None:
        if not self._loaded:
            self.load()
            self._loaded = True

    def compress(self, data: bytes, level: int = 19) -> bytes:
        """An image file as latent form and differences."""
        self._ready()
        kind, px = raster.read(data)
        latent = self.encode(px)
        stored = self.to_bytes(latent)
        rest = zstandard.ZstdCompressor(level=level).compress(residuals.residual(px, self.decode(self.from_bytes(stored))).tobytes())
        head = json.dumps({"domain": self.domain, "version": self.version(), "kind": kind, "shape": px.shape, "latent": len(stored)}, separators=(",", ":")).encode()
        return len(head).to_bytes(4, "big") + head + stored + rest

    def decompress(self, packed: bytes) -> bytes:
        """The image file anew: the same pixels. Another version of the model is refused, since its approximation differs."""
        self._ready()
        n = int.from_bytes(packed[:4], "big")
        head = json.loads(packed[4 : 4 + n])
        if (head["domain"], head["version"]) != (self.domain, self.version()):
            raise ModelMissing(f"needs {head['domain']} {head['version']}, this is {self.domain} {self.version()}")
        body = packed[4 + n :]
        rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[head["latent"] :]), np.int16).reshape(head["shape"])
        return raster.write(head["kind"], residuals.restore(self.decode(self.from_bytes(body[: head["latent"]])), rest))


class OnnxCodec(NeuralCodec):
    """A pair of ONNX models over square tensors; sessions are opened at the first use, once in each worker."""

    def load(self) -> None:
        missing = [r for r in ("encoder", "decoder") if find_model(self.domain, r) is None]
        if missing:
            raise ModelMissing(f"no {' and '.join(missing)} for {self.domain} in {', '.join(map(str, search_paths()))}")
        import onnxruntime

        self._sessions = {r: onnxruntime.InferenceSession(str(find_model(self.domain, r)), providers=["CPUExecutionProvider"]) for r in ("encoder", "decoder")}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_sessions"} | {"_loaded": False}

    def _run(self, role: str, tensor: np.ndarray) -> np.ndarray:
        s = self._sessions[role]
        return s.run(None, {s.get_inputs()[0].name: tensor})[0]

    def encode(self, image: np.ndarray) -> tuple[np.ndarray, tuple[int, ...]]:
        side = residuals.CODECS[self.domain][0]
        rgb = image if image.shape[2] == 3 else np.repeat(image[..., :1], 3, 2)
        return self._run("encoder", residuals.to_tensor(residuals.resize(rgb, side, side))).astype(np.float32), image.shape

    def decode(self, latent: tuple[np.ndarray, tuple[int, ...]]) -> np.ndarray:
        values, (h, w, n) = latent
        return residuals.resize(residuals.from_tensor(self._run("decoder", values)), h, w)[..., :n]

    def to_bytes(self, latent: tuple[np.ndarray, tuple[int, ...]]) -> bytes:
        values, shape = latent
        head = json.dumps([values.shape, shape]).encode()
        return len(head).to_bytes(4, "big") + head + values.tobytes()

    def from_bytes(self, data: bytes) -> tuple[np.ndarray, tuple[int, ...]]:
        n = int.from_bytes(data[:4], "big")
        dims, shape = json.loads(data[4 : 4 + n])
        return np.frombuffer(data[4 + n :], np.float32).reshape(dims), tuple(shape)

    def version(self) -> str:
        return "1.0.0"


SYSTEM: dict[str, NeuralCodec] = {d: OnnxCodec(d) for d in residuals.CODECS}


def get(domain: str) -> NeuralCodec:
    if domain not in SYSTEM:
        raise KeyError(f"no learned codec for {domain}; there are {', '.join(SYSTEM)}")
    return SYSTEM[domain]


def register(c: NeuralCodec) -> None:
    SYSTEM[c.domain] = c


def available_domains(folders: Sequence[Path] | None = None) -> list[str]:
    """The domains whose models are there."""
    return [d for d in SYSTEM if models_available(d, folders)]
