"""Settings that aren't tables: dotenv files, names of outputs, parameters of providers."""

from __future__ import annotations

import re
from collections.abc import MutableMapping


def dotenv(text: str, env: MutableMapping[str, str]) -> None:
    """KEY=VALUE lines into env; matching quotes come off, comments are skipped, set keys stay."""
    for found in re.finditer(r"(?m)^[ \t]*([^#=\s][^=\n]*?)[ \t]*=[ \t]*(.*?)[ \t]*$", text):
        quoted = re.fullmatch(r"(['\"])(.*)\1", found[2])
        env.setdefault(found[1], quoted[2] if quoted else found[2])


def output_name(provider: str, manifest: str, thinking: bool = False) -> str:
    """The file of a provider's labels for a sample manifest."""
    stem = re.sub(r"\.[^.]*$", "", manifest.rpartition("/")[2])
    return f"{provider}_annotations_{'thinking' if thinking else 'default'}_{stem.removeprefix('sample_manifest_')}.jsonl"


#: Payload keys by a provider's style, without and with thinking.
STYLES = {
    "thinking": ({"thinking": {"type": "disabled"}}, {"thinking": {"type": "enabled"}, "reasoning_effort": "high"}),
    "reasoning": ({"reasoning": {"effort": "none"}}, {"reasoning": {"effort": "xhigh"}}),
}


def provider_parameters(style: str | None, thinking: bool) -> dict:
    """Extra payload keys; none for a provider of unknown style."""
    return STYLES[style][thinking] if style in STYLES else {}
