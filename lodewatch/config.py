"""Settings of the script log policy, read once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from lodewatch.functions.tables import SCRIPT_SEVERITIES


@dataclass(frozen=True)
class ScriptPolicy:
    """What to log; keys that a file lacks keep these values."""

    min_severity: str = "LOW"
    log_dedup_refs: bool = True
    capture_all_langs: bool = True
    log_clean_scripts: bool = False
    max_content_bytes: int = 8192
    pid_whitelist: tuple[int, ...] = ()
    proc_blacklist: tuple[str, ...] = ()

    @classmethod
    def parsed(cls, text: str) -> ScriptPolicy:
        """From JSON, with the keys at the top or under ``filter``; keys of other names are ignored."""
        found = json.loads(text)
        found = found.get("filter", found)
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in cls.__dataclass_fields__}
        out = cls(**known)
        if out.min_severity not in SCRIPT_SEVERITIES:
            raise ValueError(f"min_severity is one of {SCRIPT_SEVERITIES}")
        return out

    def arguments(self) -> dict:
        """For ``classify.should_log``."""
        return {"whitelist": self.pid_whitelist, "blacklist": self.proc_blacklist, "all_languages": self.capture_all_langs, "clean": self.log_clean_scripts, "dedup_refs": self.log_dedup_refs, "least": SCRIPT_SEVERITIES.index(self.min_severity)}
