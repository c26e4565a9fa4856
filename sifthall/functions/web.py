"""Column expressions on addresses, responses and payloads.

Built-in expressions, except for what the standard library defines exactly and SQL cannot say: relative resolution,
address classes and robots rules, which are Arrow-batched functions.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of restricted and failed pages, attachment suffixes, local host suffixes, link labels.
RESTRICTED = ("访问频繁", "请求过于频繁", "安全验证", "请输入验证码", "人机验证", "访问受限")
FAILED = ("页面不存在", "内容不存在", "访问出错", "系统错误")
ATTACHMENT = r"\.(?:pdf|docx?|xlsx?)$"
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".home", ".corp")
BENCHMARK_NETWORK = ipaddress.ip_network("198.18.0.0/15")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def query_value(url: Column, key: str) -> Column:
    """The decoded value of a query parameter; null if it is absent or the address is none."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))


def allowed(url: Column) -> Column:
    """Whether an address is http or https, without user information, on the default port."""
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    plain = F.try_parse_url(url, F.lit("USERINFO")).isNull() & host(url).isNotNull()
    return F.coalesce(plain & ((scheme == "http") & port.isin("", "80") | (scheme == "https") & port.isin("", "443")), F.lit(False))


def is_attachment(url: Column) -> Column:
    parts = (F.try_parse_url(url, F.lit("PATH")), query_value(url, "filename"), query_value(url, "pathname"))
    tests = [F.coalesce(F.lower(p).rlike(ATTACHMENT), F.lit(False)) for p in parts]
    return tests[0] | tests[1] | tests[2]


def link_kind(label: Column, url: Column) -> Column:
    """Kind of a related link; the order of the tests matters. Empty if it is none."""
    solid = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", "")
    return F.when(F.contains(solid, F.lit("政策解读")), "政策解读").when(F.contains(solid, F.lit("阅办联动")), "阅办联动").when(is_attachment(url) | F.contains(solid, F.lit("附件")), "附件").otherwise("")


def source_id(url: Column, parameter: str = "businessId") -> Column:
    """The record id that an address carries: a query parameter, else five digits or more before its end."""
    return F.coalesce(F.nullif(query_value(url, parameter), F.lit("")), F.nullif(F.regexp_extract(url, r"(?:/|id=)(\d{5,})(?:\.html|&|$)", 1), F.lit("")))


def payload_error(url: Column, content_type: Column, payload: Column) -> Column:
    """struct(error, detail) of an attachment's bytes: empty, a web page, a wrong magic number, or none."""
    start = F.lower(F.ltrim(F.decode(F.substring(payload, 1, 2048), "ISO-8859-1")))
    page = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html")) | start.rlike("^(?:<!doctype|<html)")
    suffix = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1)), F.lit("")) for p in (F.try_parse_url(url, F.lit("PATH")), query_value(url, "filename"), query_value(url, "pathname"))], F.lit(""))
    magic = F.hex(F.substring(payload, 1, 4))
    error = (
        F.when(F.coalesce(F.length(payload), F.lit(0)) == 0, "empty_file").when(page, "html_error").when((suffix == ".pdf") & (magic != "25504446"), "invalid_pdf")
        .when(suffix.isin(".docx", ".xlsx") & (F.substring(magic, 1, 4) != "504B"), "invalid_office_file").when(suffix.isin(".doc", ".xls") & (magic != "D0CF11E0"), "invalid_office_file").otherwise("")
    )
    return F.struct(error.alias("error"), F.when(error == "", F.concat(F.lit("download_size="), F.length(payload).cast("string"))).alias("detail"))


def plain_text(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("|".join(phrases)), F.lit(False))


def _facts(status: Column, text: Column, is_html: Column, empty_body: Column) -> tuple[Column, Column, Column]:
    restricted = F.coalesce(status.isin(403, 429), F.lit(False)) | any_of(text, RESTRICTED)
    failed = any_of(text, FAILED)
    empty = empty_body | (is_html & (F.trim(F.coalesce(text, F.lit(""))) == ""))
    return restricted, failed, empty


def fetched_result(status: Column, text: Column, is_html: Column, empty_body: Column) -> Column:
    """struct(result, error_type) of a page fetched over HTTP. The two orders differ: a restricted page always needs a
    review, but an empty one is reported as empty."""
    restricted, failed, empty = _facts(status, text, is_html, empty_body)
    ok = status.between(200, 399) & ~empty & ~failed & ~restricted
    result = F.when(ok, "ok").when(restricted, "review_required").otherwise("broken")
    error = F.when(empty, "empty_page").when(restricted, "access_restricted").when(failed, "business_error").when(status >= 400, "http_error").otherwise("")
    return F.struct(result.alias("result"), error.alias("error_type"))


def rendered_result(status: Column, text: Column, attachment: Column) -> Column:
    """struct(result, error_type) of a rendered page: restricted, empty (no attachment), failed, by status."""
    restricted, failed, _ = _facts(status, text, F.lit(False), F.lit(False))
    empty = (F.trim(F.coalesce(text, F.lit(""))) == "") & ~attachment
    error = F.when(restricted, "access_restricted").when(empty, "empty_page").when(failed, "business_error").when(status >= 400, "http_error").otherwise("")
    return F.struct(F.when(error == "", "ok").when(error == "access_restricted", "review_required").otherwise("broken").alias("result"), error.alias("error_type"))


def attachment_result(status: Column, payload_is_ok: Column, location: Column) -> Column:
    """struct(result, error_type) of an attachment's response."""
    redirect = status.between(300, 399)
    error = F.when(redirect & (F.coalesce(location, F.lit("")) == ""), "redirect_without_location").when(redirect, "redirect_requires_review").when(status.isin(403, 429), "access_restricted").when(status.isin(200, 206) & payload_is_ok, "").when(status.isin(200, 206), "invalid_payload").otherwise("http_error")
    return F.struct(F.when(error == "", "ok").when(error == "access_restricted", "review_required").otherwise("broken").alias("result"), error.alias("error_type"))


def click_result(status: Column) -> Column:
    """struct(result, error_type) of a click by the status it was answered with, if any."""
    error = F.when(status.isNull(), "click_no_response").when(status.isin(403, 429), "access_restricted").when(status < 400, "").otherwise("http_error")
    return F.struct(F.when(error == "", "ok").when(error == "access_restricted", "review_required").otherwise("broken").alias("result"), error.alias("error_type"))


def network_error(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike("timed? ?out"), "timeout").when(low.rlike("certificate|ssl"), "certificate").when(low.rlike("name or service|getaddrinfo|nodename"), "dns").when(low.rlike("connect"), "connection").otherwise("transport")


def observed_status(statuses: Column) -> Column:
    """The first 403 or 429 of several responses, else the last, else 200."""
    return F.coalesce(F.try_element_at(F.filter(statuses, lambda s: s.isin(403, 429)), F.lit(1)), F.try_element_at(statuses, F.lit(-1)), F.lit(200))


def response_for(responses: Column, *urls: Column) -> Column:
    """Status of the last response (struct url, status) for the first of ``urls`` that has one, else of the last response."""
    def last_of(url: Column) -> Column:
        return F.try_element_at(F.filter(responses, lambda r: r["url"] == url), F.lit(-1))["status"]

    return F.coalesce(*[last_of(u) for u in urls], F.try_element_at(responses, F.lit(-1))["status"])


def walk_redirects(hops: Column, most: int = 6, check: bool = False) -> Column:
    """struct(chain, end) over hops (struct url, status, location): the addresses up to the first answer that is no
    redirect, and ``ok``, ``redirect_without_location`` or ``too_many_redirects``. With ``check`` each hop must be an allowed
    address, or the walk ends with ``blocked_target``."""
    start = F.struct(F.array().cast("array<string>").alias("chain"), F.lit("").alias("end"))

    def step(state: Column, hop: Column) -> Column:
        redirect = hop["status"].between(300, 399)
        blocked = ~allowed(hop["url"]) if check else F.lit(False)
        end = F.when(blocked, "blocked_target").when(~redirect, "ok").when(F.coalesce(hop["location"], F.lit("")) == "", "redirect_without_location").otherwise("")
        done = state["end"] != ""
        return F.struct(F.when(done, state["chain"]).otherwise(F.array_append(state["chain"], hop["url"])).alias("chain"), F.when(done, state["end"]).otherwise(end).alias("end"))

    return F.aggregate(F.slice(hops, 1, most), start, step, lambda s: F.struct(s["chain"].alias("chain"), F.when(s["end"] == "", "too_many_redirects").otherwise(s["end"]).alias("end")))


def resolve(base: Column, relative: Column) -> Column:
    """A relative address against its base, exactly by RFC 3986 as the standard library has it."""

    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(work, "string")(base, relative)


def is_public(name: Column, addresses: Column, literal: Column) -> Column:
    """Whether a host and all addresses it resolves to are public. ``literal``: the host is itself an address. The name is
    judged by a pattern, and only the classes of addresses need the standard library. Addresses of the benchmark network
    pass where a name resolved to them."""
    local = r"(?i)(?:^|\.)localhost\.?$|(?:" + "|".join(x.replace(".", r"\.") for x in LOCAL_SUFFIXES) + r")\.?$"
    named = F.coalesce(~name.rlike(local) & name.rlike(r"[^.]") & (literal | name.rlike(r"[^.]\.[^.]")), F.lit(False))

    def classes(found: pd.Series) -> pd.Series:
        def least(texts) -> int:
            kinds = []
            for text in texts if texts is not None else ():
                try:
                    address = ipaddress.ip_address(text)
                except ValueError:
                    return 0
                kinds.append(2 if address.is_global else 1 if address in BENCHMARK_NETWORK else 0)
            return min(kinds, default=0)

        return found.map(least)

    worst = F.pandas_udf(classes, "int")(addresses)
    return named & (worst >= F.when(literal, 2).otherwise(1))


def permitted(robots: Column, url: Column, agent: str = "*") -> Column:
    """Whether a robots file permits an address; files are parsed once per distinct text in a batch."""

    def work(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, urls in frames:
            parsers: dict[str, RobotFileParser] = {}
            out = []
            for text, u in zip(texts, urls, strict=True):
                text = text or ""
                if text not in parsers:
                    parsers[text] = RobotFileParser()
                    parsers[text].parse(text.splitlines())
                out.append(u is not None and parsers[text].can_fetch(agent, u))
            yield pd.Series(out)

    return F.pandas_udf(work, "boolean")(robots, url)
