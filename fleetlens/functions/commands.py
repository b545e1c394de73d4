"""Command manifests (argv arrays and command text) for a whole sweep.

Transmit command: path, subcommand (sender ``generate``, receiver ``receive``,
any other role none), URI ``<scheme>host:port[?params]``, then every option in
order, followed by its value only when the value is truthy (a null or empty
value gives a bare flag).  Text form quotes the URI argument only.

Capture command: ``path -i IF -f "udp port N" -s 1500 -w FILE``; text form
quotes every argument containing a space.

Pure column expressions: no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens.fixed import (CAPTURE_FILTER_PREFIX, CAPTURE_SNAPLEN, NULL_TEXT, SUBCOMMANDS,
                             URI_SCHEME)
from fleetlens.functions.params import render_map


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def transmit_uri(host, port, attrs) -> Column:
    """URI with the query part only when ``attrs`` is present (an empty map
    still yields a trailing ``?``, as the spec runner does)."""
    base = F.concat(F.lit(URI_SCHEME), F.coalesce(_c(host), F.lit("")), F.lit(":"),
                    _c(port).cast("string"))
    a = _c(attrs)
    return F.when(a.isNull(), base).otherwise(F.concat(base, F.lit("?"), render_map(a)))


def option_args(options) -> Column:
    """Options map -> flat argv part; bare flag when the value is null or ''."""
    o = _c(options)
    parts = F.transform(
        F.map_entries(o),
        lambda e: F.when(e["value"].isNull() | (e["value"] == ""), F.array(e["key"]))
                   .otherwise(F.array(e["key"], e["value"])))
    return F.coalesce(F.flatten(parts), F.array().cast("array<string>"))


def subcommand(role) -> Column:
    r = _c(role)
    expr = None
    for k, v in SUBCOMMANDS.items():
        expr = (F.when(r == k, F.array(F.lit(v))) if expr is None
                else expr.when(r == k, F.array(F.lit(v))))
    return expr.otherwise(F.array().cast("array<string>"))


def transmit_argv(path, role, host, port, attrs, options) -> Column:
    return F.concat(F.array(_c(path).cast("string")), subcommand(role),
                    F.array(transmit_uri(host, port, attrs)), option_args(options))


def transmit_text(argv) -> Column:
    return F.array_join(
        F.transform(_c(argv), lambda a: F.when(a.startswith(URI_SCHEME), F.concat(F.lit('"'), a, F.lit('"')))
                                         .otherwise(F.coalesce(a, F.lit(NULL_TEXT)))),
        " ")


def capture_argv(path, interface, port, tracefile) -> Column:
    return F.array(_c(path).cast("string"), F.lit("-i"), _c(interface).cast("string"),
                   F.lit("-f"), F.concat(F.lit(CAPTURE_FILTER_PREFIX), _c(port).cast("string")),
                   F.lit("-s"), F.lit(str(CAPTURE_SNAPLEN)),
                   F.lit("-w"), _c(tracefile).cast("string"))


def _quote_spaced(a: Column) -> Column:
    return F.when(F.instr(a, " ") > 0, F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)


def capture_text(argv) -> Column:
    """Capture argv -> text, quoting each element that holds a space; a null element is
    written out, so that a missing argument shows."""
    a = F.transform(_c(argv), lambda x: _quote_spaced(F.coalesce(x, F.lit(NULL_TEXT))))
    return F.array_join(a, " ")
