"""A finite-state parser for lines of captions and transcripts."""

from __future__ import annotations

import re

# Hesitation sounds, each letter as often as it is drawn out.
FILLERS = r"u+h+m*|u+m+|h+m+|m{2,}|e+r+m*|e+h+m*|e+m+|e+u+h+|h+e+u+|h+u+m+|[äö]+h+m*|[äö]+m+|a+h+m*|э+(?:-э+)*м*|м{2,}|嗯+|呃+|额+"

_CLOCK = r"(?:\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?|\d+h\d{1,2}m\d{1,2}(?:[.,]\d{1,3})?s)"
_STAMP = rf"(?:\[\s*{_CLOCK}\s*\]|\(\s*{_CLOCK}\s*\)|<\s*{_CLOCK}\s*>|（\s*{_CLOCK}\s*）|【\s*{_CLOCK}\s*】|{_CLOCK}(?:\s*-->\s*{_CLOCK})?)"
_NOTE = r"(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\([^()]*\)|<[^<>]*>|（[^（）]*）|【[^【】]*】|\*[^*\n]+\*|♪[^♪\n]*♪)"
_BLANK = r"[\s\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]"

STAMP = re.compile(rf"{_BLANK}*{_STAMP}(?:{_BLANK}*[-–—|]+(?={_BLANK}))?")
MARK = re.compile(rf"{_BLANK}*(?:>>+|[-–—•>]){_BLANK}+(?=\S)|{_BLANK}*>>+")
#: Names: voice tags, bold, brackets; then names up to a colon, then up to a dash.
NAME = re.compile(
    rf"{_BLANK}*(?:<v(?:\.[^\s>]+)?\s+(?P<voice>[^>]{{1,80}})>|\*\*\s*(?P<bold>[^*]{{1,80}}?)\s*(?:[:：]\s*\*\*|\*\*\s*[:：])"
    rf"|\[(?P<bracket>[^\[\]]{{1,80}}(?:\[[^\[\]]{{1,20}}\])?)\]\s*[:：]?|(?P<colon>[^\s:：\[\]<>♪*([（【][^:：\[\]<>♪*([（【\n]{{0,60}}(?:[(\[][^)\]]{{1,20}}[)\]]\s*)?)[:：](?!\d)"
    rf"|(?P<dash>[^\s:：\[\]<>♪*([（【][^:：\[\]<>♪*([（【\n—–]{{0,60}}(?:[(\[][^)\]]{{1,20}}[)\]]\s*)?)\s[—–]\s)"
)
NOISE = re.compile(rf"(?>{_NOTE}|{_STAMP}|(?:{FILLERS})(?!\w)|[\W_])*+", re.IGNORECASE)
_CLEAN = re.compile(rf"{_STAMP}{_BLANK}*[-–—]?|{_NOTE}|(?<!\w)(?:{FILLERS})(?!\w)[,.…，。]*", re.IGNORECASE)
_CJK_FILLER = re.compile(r"(?:嗯+|呃+|额(?=[，,]))[，,…]?")
_PLAIN = re.compile(r"[^\[\]()<>*♪:：—–\-【】（）•\d\s_.,…@][^\[\]()<>*♪:：—–【】（）]*")


class Line:
    """What one line holds: candidate names before the words, and where the words begin."""

    __slots__ = ("body", "names", "spoken")

    def __init__(self, text: str | None):
        """States: START takes time stamps and marks, NAME a name in one of the layouts, BODY the rest.

        A bracket may hold a name or a sound, which only the labels of the
        session can tell, so each is kept as a candidate.
        """
        self.names: list[str] = []
        self.body, self.spoken = 0, False
        if not text:
            return
        if _PLAIN.fullmatch(text):
            self.spoken = NOISE.fullmatch(text) is None
            return
        at, state = 0, "START"
        while state != "BODY":
            if m := STAMP.match(text, at):
                at = m.end()
            elif m := MARK.match(text, at):
                at = m.end()
            elif m := NAME.match(text, at):
                kind = m.lastgroup
                self.names.append(m[kind].strip())
                # Words before a colon or dash may be speech: they are cut off as a name, or nothing but noise follows.
                if kind in ("colon", "dash") and not _namelike(m[kind]):
                    self.names.pop()
                    state = "BODY"
                    continue
                at = m.end()
                state = "START" if kind == "bracket" else "BODY"
            else:
                state = "BODY"
        self.body = at
        self.spoken = NOISE.fullmatch(text, at) is None


def _namelike(text: str) -> bool:
    """Up to five parts without digits but in default names, and without the signs of a sentence."""
    text = text.strip()
    return 0 < len(text) <= 60 and len(text.split()) <= 5 and not re.search(r"[!?。！？，;；\"“”]", text)


def clean_text(text: str | None, body: int = 0) -> str:
    """The spoken words: without stamps, names, sounds and standalone fillers, with single blanks."""
    if not text:
        return ""
    out = _CJK_FILLER.sub("", _CLEAN.sub(" ", text[body:]))
    out = re.sub(r"[♪\ufeff\u200b\u2060]+", "", out)
    out = re.sub(r"\s+([,.!?;:，。！？…])", r"\1", " ".join(out.split()))
    return out.strip(" -–—")
