"""Conversation tokens, and Arabic text shaped for displays that neither join letters nor turn lines."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(conversation_id: str, secret: str) -> str:
    return hmac.new(secret.encode(), conversation_id.encode(), hashlib.sha256).hexdigest()


def is_signed(conversation_id: str, token: str | None, secret: str) -> bool:
    """Whether a token is the conversation's, compared in constant time."""
    return hmac.compare_digest(sign(conversation_id, secret).encode(), (token or "").encode())


def _xor(key: bytes, pad: int) -> Column:
    return F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0")))


def signed(conversation_id: Column, secret: str) -> Column:
    """``sign`` for a column: the nested hashes of HMAC-SHA256, in the engine."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner = F.unhex(F.sha2(F.concat(_xor(key, 0x36), conversation_id.cast("binary")), 256))
    return F.sha2(F.concat(_xor(key, 0x5C), inner), 256)


@lru_cache(1)
def _forms() -> dict[str, dict[str, str]]:
    """Each Arabic letter's presentation forms by position, read off their Unicode decompositions."""
    out: dict[str, dict[str, str]] = {}
    for code in range(0xFE80, 0xFEFD):
        kind, *letters = unicodedata.decomposition(chr(code)).split()
        base = "".join(chr(int(x, 16)) for x in letters)
        out.setdefault(base, {})[kind.strip("<>")] = chr(code)
    return out


def _joins(c: str, side: str) -> bool:
    found = _forms().get(c, {})
    return bool(found) and ("initial" in found if side == "after" else "final" in found)


def shaped(text: str) -> str:
    """Letters in their joined forms, lam-alef as one sign, each right-to-left run turned round; other text as it is."""
    forms, out, i = _forms(), [], 0
    while i < len(text):
        pair = text[i : i + 2]
        c = pair if pair in forms and len(pair) == 2 else text[i]
        found = forms.get(c)
        if not found:
            out.append(text[i])
            i += 1
            continue
        before = i > 0 and _joins(text[i - 1], "after") and "final" in found
        nxt = text[i + len(c) : i + len(c) + 1]
        after = len(c) == 1 and "initial" in found and _joins(nxt, "before")
        kind = "medial" if before and after else "final" if before else "initial" if after else "isolated"
        out.append(found.get(kind) or found.get("isolated") or c)
        i += len(c)
    runs, run = [], []
    for c in out:
        strong = unicodedata.bidirectional(c)
        if strong in ("R", "AL") or run and strong in ("WS", "NSM", "CS", "ON"):
            run.append(c)
        else:
            runs += [*_turned(run), c]
            run = []
    return "".join([*runs, *_turned(run)])


def _turned(run: list[str]) -> list[str]:
    """A run from its end, with white space and signs that follow it left behind it."""
    end = len(run)
    while end and unicodedata.bidirectional(run[end - 1]) not in ("R", "AL"):
        end -= 1
    return [*reversed(run[:end]), *run[end:]]
