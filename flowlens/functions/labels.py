"""Label normalisation and label -> category -> verdict label, per dataset family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attack name -> category, by dataset.
KDD_CATEGORY = {
    "normal": "normal",
    "back": "dos", "land": "dos", "neptune": "dos", "pod": "dos", "smurf": "dos", "teardrop": "dos",
    "apache2": "dos", "udpstorm": "dos", "processtable": "dos", "worm": "dos", "mailbomb": "dos",
    "satan": "probe", "ipsweep": "probe", "nmap": "probe", "portsweep": "probe", "mscan": "probe", "saint": "probe",
    "guess_passwd": "r2l", "ftp_write": "r2l", "imap": "r2l", "phf": "r2l", "multihop": "r2l", "warezmaster": "r2l",
    "warezclient": "r2l", "spy": "r2l", "xlock": "r2l", "xsnoop": "r2l", "snmpguess": "r2l", "snmpgetattack": "r2l",
    "httptunnel": "r2l", "sendmail": "r2l", "named": "r2l",
    "buffer_overflow": "u2r", "loadmodule": "u2r", "perl": "u2r", "rootkit": "u2r", "xterm": "u2r", "ps": "u2r",
    "sqlattack": "u2r",
}
IDS2017_CATEGORY = {
    "benign": "normal",
    "dos hulk": "dos", "dos goldeneye": "dos", "dos slowloris": "dos", "dos slowhttptest": "dos", "ddos": "dos",
    "heartbleed": "dos",
    "portscan": "probe",
    "ftp-patator": "r2l", "ssh-patator": "r2l", "bot": "r2l", "infiltration": "u2r",
    "web attack-brute force": "r2l", "web attack-xss": "r2l", "web attack-sql injection": "r2l",
}
NB15_CATEGORY = {
    "normal": "normal", "dos": "dos", "reconnaissance": "probe", "generic": "r2l", "exploits": "r2l", "fuzzers": "r2l",
    "analysis": "r2l", "backdoor": "r2l", "shellcode": "r2l", "worms": "r2l",
}
DOH_CATEGORY = {
    "benign": "normal", "nondoh": "normal", "dnscat2": "lateral_movement", "dnscat": "lateral_movement",
    "dns2tcp": "lateral_movement", "iodine": "lateral_movement",
}
DNS_CATEGORY = {"benign": "normal", "heavy": "lateral_movement", "light": "lateral_movement"}
FLOOD_FAMILIES = (
    "ldap", "mssql", "netbios", "portmap", "snmp", "ssdp", "udp", "udplag", "syn", "tftp", "webddos", "dns", "ntp",
)
CAPTURE_FAMILIES = (
    ("normal", ("benign",)), ("probe", ("recon", "vulnerabilityscan")), ("dos", ("ddos", "dos-", "mirai")),
)
CATEGORY_LABEL = {
    "normal": "benign", "dos": "flood", "probe": "port_scan", "lateral_movement": "lateral_movement",
}

DASHES = "[–—]"
ALL_DASHES = "[–—−]"


def lookup(value: Column, table: Mapping[str, str | int]) -> Column:
    """Small fixed dictionary as an expression; NULL for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def squeeze(value: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def clean_2017(value: Column) -> Column:
    s = squeeze(F.regexp_replace(value, DASHES, "-"))
    return F.lower(F.regexp_replace(s, " ?- ?", "-"))


def clean_2018(value: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(value, ALL_DASHES, "-")))


def clean_2019(value: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(value)), r"[-\s_]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def clean_plain(value: Column) -> Column:
    return F.lower(squeeze(value))


def category_kdd(value: Column) -> Column:
    """An unknown attack name counts as r2l."""
    return F.coalesce(lookup(value, KDD_CATEGORY), F.lit("r2l"))


def category_2017(value: Column) -> Column:
    return lookup(clean_2017(value), IDS2017_CATEGORY)


def category_2018(value: Column) -> Column:
    s = clean_2018(value)
    return (F.when(s == "benign", "normal")
            .when(s.startswith("dos attack") | s.startswith("ddos attack"), "dos")
            .when(s.isin("infilteration", "infiltration"), "probe"))


def category_2019(value: Column) -> Column:
    s = clean_2019(value)
    family = F.regexp_replace(F.regexp_replace(s, "^drdos_?", ""), "^_+", "")
    return F.when(s.isin("benign", "normal"), "normal").when(family.isin(*FLOOD_FAMILIES), "dos")


def category_nb15(value: Column) -> Column:
    return lookup(clean_plain(value), NB15_CATEGORY)


def category_capture(folder: Column) -> Column:
    """Family folder of a capture; prefixes decide."""
    s, out = F.lower(F.trim(folder)), None
    for category, starts in CAPTURE_FAMILIES:
        hit = None
        for start in starts:
            hit = s.startswith(start) if hit is None else hit | s.startswith(start)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def verdict_label(category: Column) -> Column:
    """Verdict label of a category; r2l and u2r have none."""
    return lookup(category, CATEGORY_LABEL)


def is_header_row(label: Column) -> Column:
    """A header line repeated inside the data."""
    return F.lower(F.trim(F.regexp_replace(label, "﻿", ""))) == "label"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def first_token_class(text: Column, table: Mapping[str, str]) -> Column:
    """Class of the first known token."""
    return F.try_element_at(F.filter(F.transform(tokens(text), lambda t: lookup(t, table)),
                                     lambda c: c.isNotNull()), F.lit(1))


def agreed_token_class(text: Column, table: Mapping[str, str]) -> Column:
    """Class of the known tokens when they agree; contradicting tokens give nothing."""
    found = F.array_distinct(F.filter(F.transform(tokens(text), lambda t: lookup(t, table)), lambda c: c.isNotNull()))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def path_class(sources: Sequence[Column], table: Mapping[str, str]) -> Column:
    """First source (directory, then file, then row label) whose tokens agree on a class."""
    return F.coalesce(*[agreed_token_class(s, table) for s in sources])


def class_frame(rows, label: str, mapping: Mapping[str, str]):
    """Keeps the mapped labels only, renamed to the frame's classes (for a lane that knows fewer)."""
    return rows.withColumn(label, lookup(F.col(label), mapping)).filter(F.col(label).isNotNull())
