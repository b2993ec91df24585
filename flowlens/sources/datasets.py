"""The public flow datasets as flow rows.

``read_flows`` returns every scanned row in the flow-row shape plus ``ts`` (NULL without a clock), ``file``,
``file_rank``, ``position`` and ``reject_reason`` (NULL for a usable row), so drops are counted, never lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import fields as V
from flowlens.functions import labels as L
from flowlens.operators import quality
from flowlens.schemas import FLOW_ROW
from flowlens.sources import archives, files

# Column lists and file names of the releases.
KDD_COLUMNS = (
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count",
    "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty")
DNS_FEATURES = ("FQDN_count", "subdomain_length", "upper", "lower", "numeric", "entropy", "special", "labels", "labels_max",
                "labels_average", "longest_word", "sld", "len", "subdomain")
DNS_TEXT = ("sld", "longest_word")
DNS_FOLDERS = ("benign_labeled", "heavy_attack_labeled", "light_attack_labeled")
DOH_FILES = ("Benign-DoH.csv", "DNSCat2-DoH.csv", "dns2tcp-DoH.csv", "iodine-DoH.csv")
IDS2017_FIRST = (
    "friday-workinghours-afternoon-ddos", "friday-workinghours-afternoon-portscan", "wednesday-workinghours",
    "thursday-workinghours-morning-webattacks", "thursday-workinghours-afternoon-infilteration", "friday-workinghours-morning",
    "tuesday-workinghours", "monday-workinghours")
IDS2018_REQUIRED = ("Dst Port", "Protocol", "Timestamp", "Flow Duration", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Label")
IDS2018_EXCLUDED = ("Timestamp", "Label", "Dst Port", "Protocol", "TotLen Fwd Pkts", "TotLen Bwd Pkts")
DDOS2019_REQUIRED = ("Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Timestamp",
                     "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Label")
DDOS2019_EXCLUDED = ("Unnamed: 0", "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol",
                     "Timestamp", "Label", "SimillarHTTP", "Inbound")
MONITORED_2018 = "172.31.69.1"
MONITORED_DNS = "10.30.0.1"

OWN = ("file", "file_rank", "position", "ts")


def features_of(raw: DataFrame, *excluded: str) -> list[str]:
    skip = {*excluded, *OWN}
    return [c for c in raw.columns if c not in skip and not c.startswith("_")]


def flow_shape(raw: DataFrame, reject: Column, key: Column, **columns: Column) -> DataFrame:
    """Selects the shared columns in order; what a dataset lacks gets its default.

    ``key`` identifies the feature vector by the release's own features. It costs nothing where no guard reads it.
    """
    default = {"source_port": F.lit(None), "difficulty": F.lit(0), "origin": F.lit("real"),
               "label": L.verdict_label(columns["category"])}
    out = [({**default, **columns})[f.name].cast(f.dataType).alias(f.name) for f in FLOW_ROW.fields]
    ts = F.col("ts") if "ts" in raw.columns else F.lit(None).cast("timestamp")
    return raw.select(*out, ts.alias("ts"), "file", "file_rank", "position", reject.alias("reject_reason"), key.alias("_key"))


def unmapped(raw_label: Column, category: Column) -> Column:
    return F.when(category.isNull(), F.concat(F.lit("unmapped:"), F.coalesce(F.trim(raw_label), F.lit("<empty>"))))


def number(name: str) -> Column:
    return V.number_or_zero(F.col(f"`{name}`"))


def kdd(raw: DataFrame, with_features: bool) -> DataFrame:
    category = L.category_kdd(F.col("label"))
    source, dest = V.kdd_hosts(category, F.col("protocol_type"), F.col("service"), F.col("flag"),
                               V.int_or_null(F.col("dst_host_count")), F.col("position"))
    columns = list(KDD_COLUMNS[:41])
    return flow_shape(
        raw, F.lit(None).cast("string"), quality.vector_key(columns), source_ip=source, dest_ip=dest,
        dest_port=L.lookup(F.col("service"), V.KDD_SERVICE_PORT), protocol=V.protocol_by_name(F.col("protocol_type")),
        total_bytes=V.truncate(number("src_bytes")) + V.truncate(number("dst_bytes")),
        duration_ms=V.truncate(number("duration")) * 1000, raw_label=F.col("label"), category=category,
        difficulty=V.int_or_null(F.col("difficulty")), features=features(columns, with_features))


def number_key(columns: list[str], zero: bool = False) -> Column:
    """Key of the numeric feature map of these columns."""
    return quality.map_key(features(columns, True, zero))


def features(columns: list[str], with_features: bool, zero: bool = False) -> Column:
    if not with_features:
        return F.create_map().cast("map<string,double>")
    return V.feature_map_zero(columns) if zero else V.feature_map(columns)


def ids2017(raw: DataFrame, with_features: bool) -> DataFrame:
    label = files.utf8_or_latin(F.col("Label"))
    category = L.category_2017(label)
    columns = features_of(raw, "Source IP", "Destination IP", "Label")
    return flow_shape(
        raw, unmapped(label, category), number_key(columns), source_ip=F.trim("Source IP"), dest_ip=F.trim("Destination IP"),
        source_port=V.int_or_null(F.col("Source Port")), dest_port=V.int_or_null(F.col("Destination Port")),
        protocol=V.protocol_by_number(number("Protocol")),
        total_bytes=V.at_least_zero(V.truncate(number("Total Length of Fwd Packets") + number("Total Length of Bwd Packets"))),
        duration_ms=V.at_least_zero(V.truncate(number("Flow Duration") / 1000.0)), raw_label=F.trim(label), category=category,
        features=features(columns, with_features))


def nb15(raw: DataFrame, with_features: bool) -> DataFrame:
    category = L.category_nb15(F.col("attack_cat"))
    source, dest = V.nb15_hosts(category, F.col("proto"), F.col("service"), F.col("state"),
                                V.int_or_null(F.col("ct_srv_src")), F.col("position"))
    columns = features_of(raw, "id", "attack_cat", "label")
    return flow_shape(
        raw, unmapped(F.col("attack_cat"), category), quality.vector_key(columns), source_ip=source, dest_ip=dest,
        dest_port=L.lookup(F.col("service"), V.NB15_SERVICE_PORT), protocol=V.protocol_by_name(F.col("proto")),
        total_bytes=V.at_least_zero(V.truncate(number("sbytes") + number("dbytes"))),
        duration_ms=V.at_least_zero(V.truncate(number("dur") * 1000.0)), raw_label=F.trim("attack_cat"), category=category,
        features=features(columns, with_features))


def doh(raw: DataFrame, with_features: bool) -> DataFrame:
    named = [c for c in ("Label", "DoH") if c in raw.columns]
    stated = F.col(named[0]) if named else F.lit("")
    # The label column speaks for a file by its first row, and only where the name says nothing.
    first = raw.filter(F.col("position") == 0).select("file", L.first_token_class(stated, L.DOH_CATEGORY).alias("_stated"))
    raw = raw.join(first, "file", "left")
    raw = raw.withColumn("ts", F.col("TimeStamp").try_cast("timestamp"))
    name = files.file_name(F.col("file"))
    category = F.coalesce(L.first_token_class(name, L.DOH_CATEGORY), F.col("_stated"))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    reject = F.when(category.isNull(), "unresolved_file").when(
        ~(has(F.col("SourceIP")) & has(F.col("DestinationIP"))), "missing_endpoint")
    source_port, dest_port = V.int_or_null(F.col("SourcePort")), V.int_or_null(F.col("DestinationPort"))
    columns = features_of(raw, "Label", "DoH", "SourceIP", "DestinationIP", "TimeStamp")
    return flow_shape(
        raw, reject, number_key(columns), source_ip=F.trim("SourceIP"), dest_ip=F.trim("DestinationIP"), source_port=source_port, dest_port=dest_port,
        protocol=V.protocol_by_port(dest_port, source_port),
        total_bytes=V.at_least_zero(F.bround(number("FlowBytesSent") + number("FlowBytesReceived")).cast("bigint")),
        duration_ms=V.at_least_zero(F.bround(number("Duration") * 1000.0).cast("bigint")),
        raw_label=files.stem(name), category=category,
        features=features(columns, with_features))


def dns(raw: DataFrame, with_features: bool) -> DataFrame:
    folder, name = files.folder_name(F.col("file")), files.stem(files.file_name(F.col("file")))
    sources = [folder, name] + ([F.col("Label")] if "Label" in raw.columns else [])
    category = L.path_class(sources, L.DNS_CATEGORY)
    raw = raw.withColumn("ts", F.col("timestamp").try_cast("timestamp"))
    kept = [c for c in DNS_FEATURES if c in raw.columns]
    return flow_shape(
        raw, F.when(category.isNull(), "unresolved_class"), quality.vector_key(kept),
        source_ip=F.lit(MONITORED_DNS), dest_ip=V.hashed_host("10.40", F.coalesce(F.trim("sld"), F.lit("nan"))),
        dest_port=F.lit(53), protocol=F.lit("udp"), total_bytes=V.dns_bytes(F.col("len")), duration_ms=F.lit(0),
        raw_label=F.concat(folder, F.lit("/"), name), category=category,
        features=features([c for c in kept if c not in DNS_TEXT], with_features))


def ids2018(raw: DataFrame, with_features: bool) -> DataFrame:
    raw = files.parse_time(raw, "Timestamp", "dd/MM/yyyy HH:mm:ss")
    category = L.category_2018(F.col("Label"))
    port = V.int_or_null(F.col("Dst Port"))
    reject = F.when(L.is_header_row(F.col("Label")), "header_row").otherwise(unmapped(F.col("Label"), category))
    columns = features_of(raw, *IDS2018_EXCLUDED)
    return flow_shape(
        raw, reject, number_key(columns, zero=True), source_ip=F.lit(MONITORED_2018), dest_ip=V.port_host("10.60", port), dest_port=port,
        protocol=V.protocol_by_number(number("Protocol")),
        total_bytes=V.at_least_zero(V.truncate(number("TotLen Fwd Pkts") + number("TotLen Bwd Pkts"))),
        duration_ms=V.at_least_zero(V.truncate(number("Flow Duration") / 1000.0)), raw_label=F.trim("Label"), category=category,
        features=features(columns, with_features, zero=True))


def ddos2019(raw: DataFrame, with_features: bool) -> DataFrame:
    raw = files.parse_time(raw, "Timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    category = L.category_2019(F.col("Label"))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    reject = (F.when(L.is_header_row(F.col("Label")), "header_row")
              .when(category.isNull(), unmapped(F.col("Label"), category))
              .when(~(has(F.col("Source IP")) & has(F.col("Destination IP"))), "missing_endpoint"))
    port = V.int_or_null(F.col("Source Port"))
    columns = features_of(raw, *DDOS2019_EXCLUDED)
    return flow_shape(
        raw, reject, number_key(columns, zero=True), source_ip=F.trim("Source IP"), dest_ip=F.trim("Destination IP"),
        source_port=F.when(port.between(0, 65535), port), dest_port=V.int_or_null(F.col("Destination Port")),
        protocol=V.protocol_by_number(number("Protocol")),
        total_bytes=V.at_least_zero(V.truncate(number("Total Length of Fwd Packets") + number("Total Length of Bwd Packets"))),
        duration_ms=V.at_least_zero(V.truncate(number("Flow Duration") / 1000.0)), raw_label=F.trim("Label"), category=category,
        features=features(columns, with_features, zero=True))


@dataclass(frozen=True)
class Dataset:
    """How a release is found, checked, sampled and projected."""

    project: Callable[[DataFrame, bool], DataFrame]
    required: tuple[str, ...] = ()
    names: tuple[str, ...] | None = None
    encoding: str = "UTF-8"
    budget: str = "prefix"
    first: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ("*.csv",)
    zipped: bool = field(default=False)
    #: Are vectors of several classes and copies refused unless the caller says otherwise?
    guarded: bool = False


DATASETS = {
    "nsl_kdd": Dataset(kdd, names=tuple(KDD_COLUMNS), patterns=("*.txt", "*.csv")),
    "ids2017": Dataset(ids2017, required=("Label",), encoding="ISO-8859-1", first=IDS2017_FIRST),
    "nb15": Dataset(nb15, required=("attack_cat",), first=("training",),
                    only=("UNSW_NB15_training-set.csv", "UNSW_NB15_testing-set.csv")),
    "doh2020": Dataset(doh, first=tuple(f.lower() for f in DOH_FILES)),
    "dnsexf2021": Dataset(dns, folders=DNS_FOLDERS, guarded=True),
    "ids2018": Dataset(ids2018, required=IDS2018_REQUIRED, budget="stride"),
    "ddos2019": Dataset(ddos2019, required=DDOS2019_REQUIRED, budget="stride", zipped=True),
}


def discover(spark: SparkSession, dataset: str, path: str) -> list[str]:
    """Files of a release in reading order."""
    spec = DATASETS[dataset]
    if spec.zipped:
        try:
            return files.list_files(spark, path, ("*.zip",))
        except FileNotFoundError:
            pass
    found = files.list_files(spark, path, spec.patterns)
    last = lambda p: p.rsplit("/", 1)[-1]
    if spec.folders and any(f"/{d}/" in p for p in found for d in spec.folders):
        return [p for d in spec.folders for p in found if f"/{d}/" in p]
    if spec.only and any(last(p) in spec.only for p in found):
        found = [p for p in found if last(p) in spec.only]
    rank = lambda p: next((i for i, f in enumerate(spec.first) if f in last(p).lower()), len(spec.first))
    return sorted(found, key=lambda p: (rank(p), p))


def sample_rows(raw: DataFrame, spec: Dataset, sample_per_file: int | None, stride: int | None) -> DataFrame:
    """Row positions are exact, so every sampling rule is a filter on them."""
    if stride is not None:
        if stride < 1:
            raise ValueError("stride must be >= 1")
        return raw.filter(F.pmod("position", F.lit(stride)) == 0)
    if not sample_per_file:
        return raw
    if spec.budget == "prefix":
        return raw.filter(F.col("position") < sample_per_file)
    sizes = raw.groupBy("file").agg(F.count(F.lit(1)).alias("_size"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_size") / sample_per_file).cast("bigint"))
    return raw.join(sizes, "file").filter(
        (F.pmod("position", step) == 0) & (F.col("position") / step < sample_per_file)).drop("_size")


def read_raw(spark: SparkSession, dataset: str, path: str) -> DataFrame:
    spec, found = DATASETS[dataset], discover(spark, dataset, path)
    if found[0].lower().endswith(".zip"):
        return archives.read_zip_csv(spark, [p.removeprefix("file:") for p in found], spec.required)
    return files.read_csv(spark, found, spec.required, spec.names, spec.encoding)


def refuse_ambiguous(rows: DataFrame) -> DataFrame:
    """Marks accepted rows whose vector (``_key``) occurs with several classes."""
    fine = F.col("reject_reason").isNull()
    several = quality.ambiguous_vectors(rows.filter(fine), "_key").select("_key", F.lit(True).alias("_several"))
    marked = rows.join(several, "_key", "left")
    return marked.withColumn("reject_reason", F.when(fine & F.col("_several"), "ambiguous_vector").otherwise(
        F.col("reject_reason"))).select(rows.columns)


def refuse_copies(rows: DataFrame) -> DataFrame:
    """Marks accepted rows whose vector (``_key``) an earlier row has: by file, then by time, then by position."""
    fine = F.col("reject_reason").isNull()
    order = F.struct("file_rank", F.col("ts").isNull().alias("late"), "ts", "position", "file")
    first = rows.filter(fine).groupBy("_key").agg(F.min(order).alias("_first"))
    marked = rows.join(first, "_key", "left")
    return marked.withColumn("reject_reason", F.when(fine & (order != F.col("_first")), "duplicate_vector").otherwise(
        F.col("reject_reason"))).select(rows.columns)


def read_flows(
    spark: SparkSession,
    dataset: str,
    path: str,
    limit: int | None = None,
    sample_per_file: int | None = None,
    stride: int | None = None,
    with_features: bool = True,
    drop_ambiguous: bool | None = None,
    dedupe: bool | None = None,
) -> DataFrame:
    """Flow rows of a release, refused rows included (see ``reject_reason``).

    ``drop_ambiguous`` refuses rows whose feature vector occurs with several classes, ``dedupe`` all but the first of equal
    vectors. Vectors are made of the release's own features; by default both hold for the DNS release only.
    """
    spec = DATASETS[dataset]
    raw = sample_rows(read_raw(spark, dataset, path), spec, sample_per_file, stride)
    rows = spec.project(raw, with_features)
    if spec.guarded if drop_ambiguous is None else drop_ambiguous:
        rows = refuse_ambiguous(rows)
    if spec.guarded if dedupe is None else dedupe:
        rows = refuse_copies(rows)
    rows = rows.drop("_key")
    if limit:
        rows = rows.filter(F.col("reject_reason").isNull()).orderBy("file_rank", "position").limit(limit)
    return rows


def usable(rows: DataFrame) -> DataFrame:
    """Accepted rows in the flow-row shape with their time."""
    return rows.filter(F.col("reject_reason").isNull()).select(*[f.name for f in FLOW_ROW.fields], "ts", "file", "position")


def capture_order(rows: DataFrame) -> DataFrame:
    """By the release's own clock, rows without a time last, file order within."""
    return rows.orderBy(F.col("ts").asc_nulls_last(), "file_rank", "position")
