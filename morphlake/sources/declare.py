"""Shapes declared on Python classes.

    @declared(version=2, note="adds frozen")
    class Balance:
        owner: "Address"
        amount: "i128"
        frozen: "Option<bool>"

Without a note, the text below the class's name is one. Key spaces are declared with `key_space`;
a project has one at most.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from pathlib import Path

from morphlake.plans.model import Field, KeySpace, Shape, ShapeError, ShapeSet, Variant

#: All shapes and key spaces declared in this process.
REGISTRY = ShapeSet()
KEY_SPACES: list[KeySpace] = []
#: Folders that a walk over sources leaves out, as it does those that begin with a dot.
SKIPPED = frozenset({"__pycache__", "build", "dist", "target"})


def doc_text(doc: str | None) -> str | None:
    """The lines of a text below a class's name, trimmed and joined by a blank."""
    return " ".join(x.strip() for x in (doc or "").strip().splitlines() if x.strip()) or None


def declared(version: int, name: str | None = None, note: str | None = None, **unknown):
    if unknown:
        raise ShapeError(f"unknown arguments {', '.join(sorted(unknown))}: version, name and note are known")

    def add(cls):
        fields = tuple(Field(n, t if isinstance(t, str) else t.__name__) for n, t in cls.__annotations__.items())
        if not fields:
            raise ShapeError(f"{cls.__name__}: a shape has named fields")
        cls.shape = Shape(name or cls.__name__, version, tuple(Field(f.name, f.declared.strip("'\"")) for f in fields), note or doc_text(cls.__doc__))
        REGISTRY.insert(cls.shape)
        return cls

    return add


def payload_text(payload) -> str | None:
    """A payload's text: none for none, a text as it is, types in a row, or names with types."""
    if payload is None or isinstance(payload, str):
        return payload
    if isinstance(payload, dict):
        return ", ".join(f"{n}: {t}" for n, t in payload.items())
    return ", ".join(payload) or None


def key_space(name: str, *variants: str | tuple) -> KeySpace:
    """Variants as a name, (name, payload) or (name, payload, True) for the bookkeeping one."""
    made = []
    for v in variants:
        own, payload, marked = (*((v,) if isinstance(v, str) else v), None, False)[:3] if isinstance(v, str) or len(v) < 3 else v
        made.append(Variant(own, payload_text(payload), bool(marked)))
    space = KeySpace(name, tuple(made))
    if space not in KEY_SPACES:
        KEY_SPACES.append(space)
    return space


def declared_key_space() -> KeySpace | None:
    """The one key space that is declared, if any; several are an error that names them."""
    if len(KEY_SPACES) > 1:
        raise ShapeError(f"several key spaces are declared ({', '.join(k.name for k in KEY_SPACES)}): a dataset has one")
    return KEY_SPACES[0] if KEY_SPACES else None


def sources(root: str | Path) -> list[Path]:
    """Python files below a folder, in order of their names."""
    out = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(x for x in inner if x not in SKIPPED and not x.startswith("."))
        out += [Path(folder, x) for x in sorted(names) if x.endswith(".py")]
    return out


def load_sources(root: str | Path) -> list[Path]:
    """Runs the files that declare shapes or key spaces, which enters these in the registries."""
    found = [p for p in sources(root) if "morphlake.sources.declare" in p.read_text()]
    for p in found:
        name = f"morphlake_declared_{abs(hash(str(p.resolve())))}"
        spec = importlib.util.spec_from_file_location(name, p)
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        try:
            spec.loader.exec_module(module)
        except ShapeError as e:
            raise ShapeError(f"{p}: {e}") from e
    return found
