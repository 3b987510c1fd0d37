"""Index specifications and search parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class IndexSpec:
    """nlist: coarse clusters (0: none); m: sub-quantisers (0: vectors are kept as they are); nbits: bits of a code.

    fine: sub-quantisers of a second level, for what the first leaves over (0: none); axes: principal axes that vectors
    are projected on first (0: none).
    """

    nlist: int = 0
    m: int = 0
    nbits: int = 8
    metric: str = "l2"
    fine: int = 0
    axes: int = 0

    @property
    def ksub(self) -> int:
        return 1 << self.nbits

    @property
    def precomputed_terms(self) -> int:
        """Entries of a table of all clusters' terms for all words, were it made in advance. Searches make the probed ones only."""
        return self.nlist * self.m * self.ksub

    @property
    def kind(self) -> str:
        return ("ivf_" if self.nlist else "") + ("pq" if self.m else "flat")


def parse_index(spec: str, metric: str = "l2") -> IndexSpec:
    """Flat; PQ16; IVF4096,Flat; IVF4096,PQ16; a code size other than 8 bits as PQ16x4; a second level as PQ8+16; before any, PCA80.

    What isn't supported is refused by name.
    """
    if metric not in ("l2", "ip"):
        raise ValueError(f"metric {metric!r}: l2 or ip")
    parts = [p.strip() for p in spec.split(",")]
    for p in parts:
        if m := re.match(r"IMI|OPQ", p):
            raise NotImplementedError(f"{p}: multi-index and rotation stages are not supported ({m[0]})")
    nlist = axes = 0
    if m := re.fullmatch(r"PCA([1-9][0-9]*)", parts[0]):
        axes, parts = int(m[1]), parts[1:] or [""]
    if m := re.fullmatch(r"IVF([1-9][0-9]*)", parts[0]):
        nlist, parts = int(m[1]), parts[1:]
    if len(parts) != 1:
        raise ValueError(f"{spec!r} is no index")
    if parts[0] == "Flat":
        return IndexSpec(nlist, 0, metric=metric, axes=axes)
    if m := re.fullmatch(r"PQ([1-9][0-9]*)(?:x([1-9][0-9]*))?(?:\+([1-9][0-9]*))?", parts[0]):
        return IndexSpec(nlist, int(m[1]), int(m[2] or 8), metric, int(m[3] or 0), axes)
    raise ValueError(f"{spec!r} is no index")


@dataclass(frozen=True)
class SearchParams:
    """factor: candidates for each of the k results that an index with a second level compares by its finer codes."""

    k: int = 10
    nprobe: int = 1
    factor: int = 4


def parse_search(text: str, params: SearchParams = SearchParams()) -> SearchParams:
    """As "nprobe=32,k=10,factor=4"; names that aren't given keep the values of params."""
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(nprobe|k|factor)\s*=\s*([1-9][0-9]*)", part)
        if not m:
            raise ValueError(f"{part!r} is no search parameter")
        params = replace(params, **{m[1]: int(m[2])})
    return params
