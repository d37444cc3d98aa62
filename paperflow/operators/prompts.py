"""What a writer and a verifier are shown, as plain templates of a language; the texts are a pack that the caller may replace."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Pack:
    """Templates with {slots}. Unknown slots stay as they are."""

    system: str
    source: str
    corrections: str
    rejected: str
    verify: str


PACKS = {
    "en": Pack(
        system="Explain a paper to a reader without training, in four blocks: headline, finding, example, caution. Claim nothing that the source does not say.",
        source="Title: {title}\nVenue: {venue}\nDate: {date}\nShort summary: {tldr}\nAbstract: {abstract}",
        corrections="Your last attempt broke these rules. Mend them and change nothing else:\n{findings}",
        rejected="These passages are not borne out by the source. Write them anew from what it says:\n{spans}",
        verify="Take the example apart into claims. For each give the passage, a quote of the source and the field that it is from.\nExample: {example}\n\n{source}",
    ),
    "cs": Pack(
        system="Vysvětli práci laikovi ve čtyřech blocích: nadpis, zjištění, příklad, opatrnost. Netvrď nic, co ve zdroji není.",
        source="Název: {title}\nČasopis: {venue}\nDatum: {date}\nKrátké shrnutí: {tldr}\nAbstrakt: {abstract}",
        corrections="Minulý pokus porušil tato pravidla. Oprav je a nic jiného neměň:\n{findings}",
        rejected="Tyto pasáže zdroj nedokládá. Napiš je znovu podle něj:\n{spans}",
        verify="Rozlož příklad na tvrzení. Ke každému uveď pasáž, citát ze zdroje a pole, z něhož je.\nPříklad: {example}\n\n{source}",
    ),
}


def pack(language: str, **instead: str) -> Pack:
    """The templates of a language, some of them replaced; an unknown language is an error."""
    if language not in PACKS:
        raise ValueError(f"no prompts for {language!r}")
    return replace(PACKS[language], **instead)


def filled(template: str, slots: Mapping[str, Any]) -> str:
    out = template
    for name, value in slots.items():
        out = out.replace("{" + name + "}", "" if value is None else str(value))
    return out


def source_text(templates: Pack, row: Mapping[str, Any]) -> str:
    return filled(templates.source, {k: row.get(k) for k in ("title", "venue", "date", "tldr", "abstract")})


def correction_text(templates: Pack, findings: Sequence[Mapping[str, Any]] = (), rejected: Sequence[str] = ()) -> str:
    """What a second attempt is told: its hard findings, then the passages that verification rejected; nothing if there are none."""
    hard = [f"- {f['block']}: {f['rule']} ({f['matched']})" for f in findings if f.get("severity") == "hard"]
    parts = [filled(templates.corrections, {"findings": "\n".join(hard)})] if hard else []
    return "\n\n".join(parts + ([filled(templates.rejected, {"spans": "\n".join(f"- {s}" for s in rejected)})] if rejected else []))


def verify_text(templates: Pack, example: str, row: Mapping[str, Any]) -> str:
    return filled(templates.verify, {"example": example, "source": source_text(templates, row)})
