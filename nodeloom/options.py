"""Engine settings: one dataclass, each field overridable by an environment variable of the same name in capitals."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

# Relation tiers in order of priority: edge type, relation kinds that feed it, seed weight name.
TIERS = (
    (1, "contradicts", ("antonyms",), "contradicts"),
    (2, "applies_to", ("meronyms", "holonyms"), "applies_to"),
    (3, "is_instance_of", ("hypernyms", "hyponyms"), "is_instance_of"),
    (4, "extends", ("derived", "related"), "extends"),
    (5, "same_phenomenon", ("coordinate_terms",), "coordinate_terms"),
    (6, "same_phenomenon", ("synonyms",), "synonyms"),
)
# Seed weights of the tiers.
SEEDS = {"contradicts": 0.85, "applies_to": 0.55, "is_instance_of": 0.65, "extends": 0.60, "coordinate_terms": 0.70, "synonyms": 0.90}
# The sentence that is embedded as the type vector of each edge type.
TYPE_SENTENCES = {
    "same_phenomenon": "these two words describe the same concept",
    "contradicts": "these two words have opposite meanings",
    "extends": "one word is derived from or extends the other",
    "applies_to": "these two words share a common origin or root",
    "is_instance_of": "this relationship is a specific instance of the broader relationship",
}


def _read(now, raw: str):
    """``raw`` as a value of the type of ``now``; a flag is on unless its text is empty or a falsy JSON value."""
    if isinstance(now, bool):
        try:
            return bool(json.loads(raw.strip().lower() or "0"))
        except ValueError:
            return raw.strip().lower() not in ("no", "off")
    return type(now)(raw)


@dataclass
class Options:
    """dim: length of vectors. pair_recall: 0 for exact pairs, else the recall ``simjoin.pairs`` has to keep.
    bridge_candidates: bridges a pair is offered at first."""

    dim: int = 768
    q_min_leaf: float = 0.72
    triad_cosine: float = 0.90
    polysemy_floor: float = 0.40
    level_alpha: float = 0.5
    near_duplicate: float = 0.95
    pair_recall: float = 0.0
    bridge_candidates: int = 50
    embed_url: str = ""
    embed_model: str = ""
    fake_embedder: bool = True
    seeds: dict[str, float] = field(default_factory=lambda: dict(SEEDS))

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Options:
        """Defaults, overridden by ``NODELOOM_<FIELD>`` and ``NODELOOM_Q_SEED_<TIER>``."""
        env = dict(os.environ) if env is None else env
        o = cls()
        own = {f"NODELOOM_{f.name.upper()}": f.name for f in fields(cls) if f.name != "seeds"}
        for k in own.keys() & env.keys():
            setattr(o, own[k], _read(getattr(o, own[k]), env[k]))
        for k in o.seeds:
            o.seeds[k] = float(env.get(f"NODELOOM_Q_SEED_{k.upper()}", o.seeds[k]))
        return o
