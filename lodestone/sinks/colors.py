"""Names in the colours of LS_COLORS, for terminals."""

from __future__ import annotations

# What a terminal shows without LS_COLORS.
DEFAULT = "di=01;34:ln=01;36:ex=01;32:pi=33:so=01;35:bd=01;33:cd=01;33:su=37;41:sg=30;43:tw=30;42:ow=34;42:st=37;44"
_TYPES = {"d": "di", "l": "ln", "p": "pi", "s": "so", "b": "bd", "c": "cd"}


class Colors:
    """Styles by kind of entry and by ending of the name; of several endings that fit, the last one given counts."""

    def __init__(self, spec: str | None = None):
        self.kinds: dict[str, str] = {}
        self.endings: list[tuple[str, str]] = []
        for key, given, code in (part.partition("=") for part in (spec or DEFAULT).split(":")):
            if given and key.startswith("*"):
                self.endings.insert(0, (key[1:].lower(), code))
            elif given:
                self.kinds[key] = code

    def style(self, name: str, mode: str, broken: bool = False) -> str:
        """The codes for an entry with a mode as ls writes it; none for an entry whose mode isn't known."""
        if len(mode) != 10:
            return ""
        kind = _TYPES.get(mode[0])
        found = []
        if kind == "di":
            sticky, open_ = mode[9] in "tT", mode[8] == "w"
            found = ["tw"] * (sticky and open_) + ["ow"] * open_ + ["st"] * sticky
        elif kind == "ln":
            found = ["or"] * broken
        elif kind is None:
            found = ["su"] * (mode[3] in "sS") + ["sg"] * (mode[6] in "sS") + ["ex"] * any(c in "xst" for c in (mode[3], mode[6], mode[9]))
        named = next((self.kinds[k] for k in found + [kind or ""] if self.kinds.get(k)), "")
        if named or kind:
            return named
        return next((code for end, code in self.endings if name.lower().endswith(end)), self.kinds.get("fi", ""))

    def paint(self, name: str, mode: str, broken: bool = False) -> str:
        codes = ";".join(c.lstrip("0") for c in self.style(name, mode, broken).split(";") if c.strip("0"))
        return f"\x1b[{codes}m{name}\x1b[0m" if codes else name
