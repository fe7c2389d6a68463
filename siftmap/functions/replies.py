"""The reply function of a batch generation step, and a rule-based default.

This module runs inside Python workers, so it imports nothing from Spark.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

Reply = Callable[[list[str]], list[str]]

# How a citation is recognised, and the regions a document may be about.
CITATION = r"\[([^\s\]]+) p\.(\d+)\]"
REGIONS = [
    "Africa",
    "Asia",
    "Australasia",
    "Central and South America",
    "Europe",
    "North America",
    "Small Islands",
    "Polar Regions",
]

# Fixed value: what a synthesis says when retrieval found too little.
INSUFFICIENT = "insufficient evidence retrieved"


def _words(body: str) -> list[str]:
    return re.findall(r"[^\W\d_]{4,}", body.lower())


def _synthesis(body: str) -> dict:
    found = [(m.group(1), line) for line in body.splitlines() if (m := re.match(CITATION, line))]
    if len(found) < 2:
        return {"synthesis": None, "confidence": None, "confidence_rationale": INSUFFICIENT, "gaps": [], "citations_used": []}
    said = [re.sub(r"^(\[[^\]]+\]) (.*)", r"\2 \1.", line) for _, line in found]
    return {
        "synthesis": " ".join(said), "confidence": "medium" if len(found) > 3 else "low",
        "confidence_rationale": f"{len(found)} passages", "gaps": [], "citations_used": sorted({i for i, _ in found}),
    }


def rule_based(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        head, _, body = p.partition("\n")
        if '"synthesis"' in head:
            answer = _synthesis(body)
        elif '"decision"' in head:
            short = len(body.split()) < 30
            answer = {"decision": "needs_full_text" if short else "include", "criterion": "none" if short else "2", "agrees_with_model": not short, "reason": "length"}
        elif '"evidence_focus"' in head:
            common = Counter(_words(body)).most_common(2)
            answer = {"label": " ".join(w for w, _ in common), "sector": None, "evidence_focus": "mixed", "coherence_guess": "low"}
        elif "outcome_reported" in head:
            region = next((r for r in REGIONS if r.lower() in body.lower()), None)
            answer = {"region": region, "evidence_type": "impact" if region else "off_topic", "outcome_reported": False, "rationale": " ".join(body.split()[:12])}
        elif "JSON array" in head:
            found = [w for w, _ in Counter(_words(body)).most_common(1)]
            answer = [{"action": w, "adaptation_type": w, "outcome_direction": "mixed", "effect_size": None} for w in found]
        else:
            space = re.search(r"from: ([^.]*)\. ", head)
            options = [o.strip() for o in space.group(1).split(",")] if space else ["unknown"]
            answer = {"label": options[len(body) % len(options)], "confidence": 0.5, "rationale": " ".join(body.split()[:12])}
        out.append(json.dumps(answer, ensure_ascii=False))
    return out
