"""Signature Version 4 of requests, as Columns; the keys of a day are derived with the rest."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
from urllib.parse import parse_qsl, quote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mac(key: bytes, text: str) -> bytes:
    return hmac.new(key, text.encode(), hashlib.sha256).digest()


def signing_key(secret: str, day: str, region: str, service: str) -> bytes:
    """The key of one day (YYYYMMDD), region and service."""
    return _mac(_mac(_mac(_mac(f"AWS4{secret}".encode(), day), region), service), "aws4_request")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text under a fixed key, as lower-case hex."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def _canonical(url: str, headers: dict[str, str], now: dt.datetime) -> tuple[str, str, dict[str, str]]:
    """Path and query in canonical form, and the headers that are signed, by lower-case name."""
    at = urlsplit(url)
    path = quote(at.path or "/", safe="/-_.~%")
    query = "&".join(f"{quote(k, safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted(parse_qsl(at.query, keep_blank_values=True)))
    signed = {"host": at.netloc, "x-amz-date": f"{now:%Y%m%dT%H%M%SZ}"} | {k.lower(): " ".join(v.split()) for k, v in headers.items()}
    return path, query, dict(sorted(signed.items()))


def sigv4_headers(url: str, body: Column, region: str, service: str, key_id: str, secret: str, now: dt.datetime, method: str = "POST", headers: dict[str, str] | None = None, token: str = "") -> Column:
    """map<string, string> of the headers that sign a request with this body at `now` (UTC).

    Every header given is signed, too; a session token is one of them.
    """
    given = (headers or {}) | ({"X-Amz-Security-Token": token} if token else {})
    path, query, signed = _canonical(url, given, now)
    names = ";".join(signed)
    head = "\n".join([method, path, query, *[f"{k}:{v}" for k, v in signed.items()], "", names]) + "\n"
    scope = f"{now:%Y%m%d}/{region}/{service}/aws4_request"
    request = F.sha2(F.encode(F.concat(F.lit(head), F.sha2(F.encode(F.coalesce(body, F.lit("")), "UTF-8"), 256)), "UTF-8"), 256)
    proof = hmac_sha256(signing_key(secret, f"{now:%Y%m%d}", region, service), F.concat(F.lit(f"AWS4-HMAC-SHA256\n{signed['x-amz-date']}\n{scope}\n"), request))
    line = F.concat(F.lit(f"AWS4-HMAC-SHA256 Credential={key_id}/{scope}, SignedHeaders={names}, Signature="), proof)
    out = {"X-Amz-Date": signed["x-amz-date"]} | given
    return F.create_map(*[F.lit(x) for kv in out.items() for x in kv], F.lit("Authorization"), line)
