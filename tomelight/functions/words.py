"""Words of texts with their places, and redaction of JSON of any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

# The ranges of characters that are words by themselves, and names of fields whose values are secret.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
SECRET = (
    "password", "hashedpassword", "pwd", "passwd", "token", "accesstoken", "refreshtoken", "apikey", "secret", "secretkey", "credentials", "authorization", "auth",
    "cookie", "session", "sessionid", "privatekey", "publickey", "apitoken", "bearer", "jwt", "resettoken", "verificationtoken",
)
REDACTED = "[REDACTED]"
#: A sign of CJK, or a run of other letters and digits.
WORD = rf"[{CJK}]|(?:[^\P{{L}}{CJK}]|[^\P{{N}}{CJK}])+"


class _Words:
    def __init__(self):
        import regex

        self.word, self.digits, self.letters = regex.compile(WORD), regex.compile(r"\p{N}+"), regex.compile(r"\p{L}+")

    def eval(self, text: str, alt: str, image: bool):
        if image:
            shown = f"[IMAGE: {alt}]" if alt else "[IMAGE]"
            yield 0, 0, len(text or ""), "image", shown, shown.lower()
            return
        for k, m in enumerate(self.word.finditer(text or "")):
            w = m.group()
            kind = "cjk" if re.match(f"[{CJK}]", w) else "number" if self.digits.fullmatch(w) else "word" if self.letters.fullmatch(w) else "mixed"
            yield k, m.start(), m.end(), kind, w, w.lower()


#: word_tokens(text, alt, image): place, first and end (code points, end exclusive) of each word of a text, its kind (word, number, mixed, cjk), itself and in lower
#: case; signs that are no word are skipped. An image is one token. One row each; texts are not moved for it.
word_tokens = F.udtf(_Words, returnType="place int, first int, end int, kind string, word string, lower string", useArrow=True)


def _secret(key: str) -> bool:
    bare = re.sub(r"[-_\s]", "", key.lower())
    return any(s in bare for s in SECRET)


def _redact(value):
    """The value with secrets replaced, at any depth: without recursion, as depth is the sender's choice."""
    top = [value]
    open_ = [top]
    while open_:
        box = open_.pop()
        for k, v in list(box.items() if isinstance(box, dict) else enumerate(box)):
            if isinstance(box, dict) and _secret(k):
                box[k] = REDACTED
            elif isinstance(v, (dict, list)):
                open_.append(v)
    return top[0]


@F.pandas_udf(T.StringType())
def redacted(x: pd.Series) -> pd.Series:
    """JSON with the values of secret fields replaced, in objects and arrays of any depth; other values keep their types. Text that is no JSON is replaced whole if it names a secret."""

    def safe(s):
        try:
            return json.dumps(_redact(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):  # deeper than the parser goes, or broken
            return REDACTED if _secret(s) else s

    return x.map(safe, na_action="ignore")
