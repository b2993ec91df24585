import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from flowlens.functions.fields import flows_to_events
from flowlens.operators.quality import drop_counts
from flowlens.sources.captures import CaptureError, CaptureReader, capture_flows, capture_report, read_captures
from flowlens.sources.datasets import KDD_COLUMNS, capture_order, discover, read_flows, usable
from flowlens.sources.files import HeaderError, read_csv


def write(path, header, rows, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = ([",".join(header)] if header else []) + [",".join(str(v) for v in r) for r in rows]
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def kdd_row(label, service="http", count=10):
    values = dict.fromkeys(KDD_COLUMNS, 0)
    values.update(protocol_type="tcp", service=service, flag="SF", src_bytes=100, dst_bytes=50, duration=2,
                  dst_host_count=count, label=label, difficulty=20)
    return [values[c] for c in KDD_COLUMNS]


def test_headerless_kdd(spark, tmp_path):
    path = write(tmp_path / "KDDTrain.txt", None, [kdd_row("neptune"), kdd_row("neptune"), kdd_row("normal"), kdd_row("novel", "X11")])
    rows = read_flows(spark, "nsl_kdd", path).orderBy("position").collect()
    assert [r.category for r in rows] == ["dos", "dos", "normal", "r2l"]
    assert [r.label for r in rows] == ["flood", "flood", "benign", None]
    assert rows[0].total_bytes == 150 and rows[0].duration_ms == 2000 and rows[0].dest_port == 80 and rows[3].dest_port == 6000
    assert rows[1].source_ip == rows[0].source_ip != rows[2].source_ip
    assert rows[0].features["dst_host_count"] == 10.0 and "service" not in rows[0].features
    import hashlib
    digest = int(hashlib.sha256(b"tcp|http|SF|0|0").hexdigest()[:8], 16)
    assert rows[1].source_ip == f"10.10.{digest >> 8 & 255}.{digest & 255}"


IDS17 = ["Flow ID", " Source IP", " Source Port", " Destination IP", " Destination Port", " Protocol", " Timestamp",
         " Flow Duration", " Total Length of Fwd Packets", " Total Length of Bwd Packets", "Flow Bytes/s", " Label"]


def ids17(label, rate="1.5", us=2500):
    return ["f", "1.1.1.1", 10, "2.2.2.2", 80, 6, "t", us, 100, 20, rate, label]


def test_ids2017_padding_encoding_and_priority(spark, tmp_path):
    write(tmp_path / "Monday-WorkingHours.csv", IDS17, [ids17("BENIGN")])
    write(tmp_path / "Friday-WorkingHours-Afternoon-DDos.csv", IDS17, [ids17("DDoS", "Infinity"), ids17("Mystery")])
    write(tmp_path / "Thursday-WorkingHours-Morning-WebAttacks.csv", IDS17, [ids17("Web Attack \x96 XSS".replace("\x96", "–"))], "cp1252")
    write(tmp_path / "Tuesday-WorkingHours.csv", IDS17, [ids17("Web Attack – Brute Force", us=-10)])
    rows = read_flows(spark, "ids2017", str(tmp_path))
    good = usable(rows).collect()
    assert sorted(r.category for r in good) == ["dos", "normal", "r2l"] or sorted(r.category for r in good) == ["dos", "normal", "r2l", "r2l"]
    ddos = [r for r in good if r.category == "dos"][0]
    assert ddos.protocol == "tcp" and ddos.duration_ms == 2 and ddos.total_bytes == 120 and "Flow Bytes/s" not in ddos.features
    assert {r.reject_reason for r in drop_counts(rows).collect()} >= {"unmapped:Mystery"}
    assert min(r.duration_ms for r in good) == 0
    assert [p.rsplit("/", 1)[1][:4] for p in discover(spark, "ids2017", str(tmp_path))] == ["Frid", "Thur", "Tues", "Mond"]
    assert read_flows(spark, "ids2017", str(tmp_path), limit=1).collect()[0].category == "dos"


NB15 = ["﻿id", "dur", "proto", "service", "state", "sbytes", "dbytes", "ct_srv_src", "attack_cat", "label"]


def test_nb15_bom_and_host_shapes(spark, tmp_path):
    rows = [[i, 0.5, "udp", "dns", "CON", 10, 5, 1, cat, 1] for i, cat in
            enumerate(["Normal", "DoS", "DoS", "Reconnaissance", "Reconnaissance", " Fuzzers ", "Unknown"])]
    write(tmp_path / "UNSW_NB15_training-set.csv", NB15, rows)
    got = read_flows(spark, "nb15", str(tmp_path)).orderBy("position").collect()
    assert [r.category for r in got] == ["normal", "dos", "dos", "probe", "probe", "r2l", None]
    assert got[1].dest_ip == got[2].dest_ip and got[3].dest_ip != got[4].dest_ip and got[3].source_ip == got[4].source_ip
    assert got[0].duration_ms == 500 and got[0].dest_port == 53 and "id" not in got[0].features and got[0].features["dur"] == 0.5
    assert got[6].reject_reason == "unmapped:Unknown"


DOH = ["SourceIP", "DestinationIP", "SourcePort", "DestinationPort", "TimeStamp", "Duration", "FlowBytesSent", "FlowBytesReceived", "Label"]


def test_doh_class_from_file_name_and_clock(spark, tmp_path):
    write(tmp_path / "Benign-DoH.csv", DOH, [["a", "b", 5000, 443, "2020-01-02 10:00:01", 0.0015, 10.4, 1.2, "DoH"], ["a", "b", 1, 2, "2020-01-02 10:00:00", 1, 1, 1, "DoH"], ["a", "b", 443, 9, "never", 1, "", 1, "DoH"]])
    write(tmp_path / "iodine-DoH.csv", DOH, [["", "b", 53, 1, "2020-01-02", 1, 1, 1, "x"]])
    write(tmp_path / "mystery.csv", DOH, [["a", "b", 53, 1, "2020-01-02", 1, 1, 1, "x"]])
    rows = read_flows(spark, "doh2020", str(tmp_path))
    good = [r for r in capture_order(rows).collect() if r.reject_reason is None]
    assert [r.position for r in good] == [1, 0, 2]
    assert good[1].total_bytes == 12 and good[1].duration_ms == 2 and good[1].protocol == "tcp" and good[2].protocol == "tcp"
    assert {r.reject_reason for r in rows.collect()} == {None, "missing_endpoint", "unresolved_file"}


DNS = ["timestamp", "FQDN_count", "subdomain_length", "upper", "lower", "numeric", "entropy", "special", "labels", "labels_max",
       "labels_average", "longest_word", "sld", "len", "subdomain"]


def dns(ts, sld, length):
    return [ts, 1, 2, 0, 5, 1, 2.5, 0, 3, 4, 2.0, "N", sld, length, 1]


def test_dns_directory_beats_name_and_ambiguity(spark, tmp_path):
    write(tmp_path / "benign_labeled" / "stateless_features-light_benign.csv", DNS,
          [dns("2021-01-01 00:00:02", "x", 10), dns("2021-01-01 00:00:01", "x", 10), dns("2021-01-01 00:00:03", "shared", 12)])
    write(tmp_path / "heavy_attack_labeled" / "stateless.csv", DNS, [dns("2021-01-01 00:00:05", "shared", 12), dns("bad", "evil", 20)])
    rows = usable(read_flows(spark, "dnsexf2021", str(tmp_path), drop_ambiguous=False, dedupe=False)).collect()
    assert sorted(r.category for r in rows) == ["lateral_movement"] * 2 + ["normal"] * 3
    assert rows[0].source_ip == "10.30.0.1" and rows[0].total_bytes - 44 in (10, 12, 20) and "sld" not in rows[0].features
    guarded = read_flows(spark, "dnsexf2021", str(tmp_path))
    assert sorted((r.category, r.position) for r in usable(guarded).collect()) == [("lateral_movement", 1), ("normal", 1)]
    assert {(r.reject_reason, r.n) for r in drop_counts(guarded).collect()} == {("ambiguous_vector", 2), ("duplicate_vector", 1)}


IDS18 = ["Dst Port", "Protocol", "Timestamp", "Flow Duration", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Flow Byts/s", "Label"]


def test_ids2018_clock_headers_and_budget(spark, tmp_path):
    rows = [[443, 6, f"16/02/2018 08:00:{59 - i:02d}", 3000, 10, 5, "Infinity", lab] for i, lab in
            enumerate(["Benign", "DoS attacks-Hulk", "DDOS attack-HOIC", "Infilteration", "Label", "Brute Force -Web"] + ["Benign"] * 34)]
    path = write(tmp_path / "Friday-16-02-2018.csv", IDS18, rows)
    got = read_flows(spark, "ids2018", path)
    good = [r for r in capture_order(got).collect() if r.reject_reason is None]
    assert len(good) == 38 and good[0].position == 39 and str(good[0].ts) == "2018-02-16 08:00:20"
    assert good[0].dest_ip == "10.60.1.187" and good[0].features == {"Flow Duration": 3000.0, "Flow Byts/s": 0.0}
    assert {(r.reject_reason, r.n) for r in drop_counts(got).collect()} == {("header_row", 1), ("unmapped:Brute Force -Web", 1)}
    assert sorted(r.position for r in read_flows(spark, "ids2018", path, stride=9).collect()) == [0, 9, 18, 27, 36]
    assert sorted(r.position for r in read_flows(spark, "ids2018", path, sample_per_file=3).collect()) == [0, 13, 26]
    assert read_flows(spark, "ids2018", path, with_features=False).first().features == {}
    events = flows_to_events(usable(got))
    assert events.filter("sensor = 'zeek' and bytes = 15 and duration_ms = 3").count() == 38
    loose = write(tmp_path / "other" / "x.csv", IDS18, [[1, 6, "2018-02-16 08:00:01", 1, 1, 1, 1, "Benign"]])
    assert str(read_flows(spark, "ids2018", loose).first().ts) == "2018-02-16 08:00:01"
    with pytest.raises(HeaderError):
        read_flows(spark, "ids2018", write(tmp_path / "bad.csv", IDS17, [ids17("BENIGN")]))
    with pytest.raises(FileNotFoundError):
        read_flows(spark, "ids2018", str(tmp_path / "nothing"))


def reasons(rows):
    return {r.reject_reason: r.n for r in drop_counts(rows).collect()}


def test_guards_use_the_features_of_the_release(spark, tmp_path):
    """Every release: equal vectors are refused after the first, vectors of two classes altogether, the rest stays."""
    both = {"drop_ambiguous": True, "dedupe": True}
    rows = [[443, 6, "16/02/2018 08:00:00", us, 10, 5, 1.5, lab] for us, lab in
            [(1, "Benign"), (1, "Benign"), (2, "Benign"), (3, "DoS attacks-Hulk"), (3, "Benign"), (4, "Label")]]
    path = write(tmp_path / "a" / "Friday-16-02-2018.csv", IDS18, rows)
    kept = usable(read_flows(spark, "ids2018", path, **both)).collect()
    assert sorted(r.position for r in kept) == [0, 2]
    assert reasons(read_flows(spark, "ids2018", path, **both)) == {"ambiguous_vector": 2, "duplicate_vector": 1, "header_row": 1}
    assert sorted(r.position for r in usable(read_flows(spark, "ids2018", path, dedupe=True)).collect()) == [0, 2, 3]
    path = write(tmp_path / "b" / "KDDTrain.txt", None, [kdd_row("neptune"), kdd_row("neptune"), kdd_row("normal", count=3), kdd_row("normal", "ftp")])
    assert sorted(r.position for r in usable(read_flows(spark, "nsl_kdd", path, **both)).filter("category is not null").collect()) == [0, 2, 3]
    path = write(tmp_path / "c" / "Monday-WorkingHours.csv", IDS17, [ids17("BENIGN"), ids17("BENIGN", "2"), ids17("DDoS", "2"), ids17("BENIGN")])
    assert [r.position for r in usable(read_flows(spark, "ids2017", path, **both)).collect()] == [0]
    path = tmp_path / "day.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("a.csv", "\n".join(",".join(map(str, r)) for r in [DDOS, ddos("Syn"), ddos("Syn"), ddos("BENIGN", port=5)]) + "\n")
    assert reasons(read_flows(spark, "ddos2019", str(path), **both)) == {"ambiguous_vector": 3}
    assert reasons(read_flows(spark, "ddos2019", str(path), dedupe=True)) == {"duplicate_vector": 2}


def test_equal_path_tails_keep_their_own_rank(spark, tmp_path):
    for day in ("day1", "day2"):
        write(tmp_path / day / "part" / "a.csv", IDS17, [ids17("BENIGN", day[-1])])
    rows = read_flows(spark, "ids2017", str(tmp_path)).orderBy("file_rank").collect()
    assert [(r.file_rank, "day1" in r.file) for r in rows] == [(0, True), (1, False)]


DDOS = ["Unnamed: 0", "Flow ID", " Source IP", " Source Port", " Destination IP", " Destination Port", " Protocol", " Timestamp",
        " Flow Duration", "Total Length of Fwd Packets", " Total Length of Bwd Packets", "Flow Bytes/s", "SimillarHTTP", " Inbound", " Label"]


def ddos(label, source="172.16.0.5", port=70000):
    return [1, "id", source, port, "192.168.50.1", 80, 17, "2018-12-01 13:34:27.403713", 250000, 500, 0, "Infinity", 0, 1, label]


def test_ddos2019_members_stay_in_the_archive(spark, tmp_path):
    path = tmp_path / "day.zip"
    body = lambda rows: "\r\n".join([",".join(DDOS)] + [",".join(map(str, r)) for r in rows]) + "\r\n"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("b/Syn.csv", body([ddos("Syn"), ddos("BENIGN", "10.0.0.1", 5)]))
        archive.writestr("a/LDAP.csv", body([ddos("DrDoS_LDAP"), ddos("Label"), ddos("WebDDoS"), ddos("Mirai"), ddos("UDP-lag", " ")]))
        archive.writestr("readme.txt", "no")
    rows = read_flows(spark, "ddos2019", str(path))
    got = rows.orderBy("file_rank", "position").collect()
    assert [(r.file.split("!")[1], r.category, r.reject_reason) for r in got] == [
        ("a/LDAP.csv", "dos", None), ("a/LDAP.csv", None, "header_row"), ("a/LDAP.csv", "dos", None), ("a/LDAP.csv", None, "unmapped:Mirai"),
        ("a/LDAP.csv", None, "unmapped:UDP-lag"), ("b/Syn.csv", "dos", None), ("b/Syn.csv", "normal", None)]
    assert got[0].source_port is None and got[6].source_port == 5 and got[0].ts.microsecond == 403713
    assert got[0].features == {"Flow Duration": 250000.0, "Total Length of Fwd Packets": 500.0, "Total Length of Bwd Packets": 0.0, "Flow Bytes/s": 0.0}


def test_positions_are_exact_over_file_blocks(spark, tmp_path):
    path = write(tmp_path / "big.csv", ["v"], [[i] for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_csv(spark, [path])
        assert rows.filter(F.col("position") != F.col("v").cast("bigint")).count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- captures ---


def ipv4(src, dst, sport, dport, proto=6, fragment=0, size=40):
    body = struct.pack(">HH", sport, dport) + b"\0" * (size - 24) if proto in (6, 17) else b"\0" * (size - 20)
    return struct.pack(">BBHHHBBH", 0x45, 0, size, 0, fragment, 64, proto, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def ethernet(payload, kind=0x0800, vlan=False):
    return b"\0" * 12 + (struct.pack(">HH", 0x8100, 1) if vlan else b"") + struct.pack(">H", kind) + payload


def capture(path, frames, order="<", nano=False, link=1, cut=0):
    magic = (0xA1B23C4D if nano else 0xA1B2C3D4)
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for ts_us, frame in frames:
        data += struct.pack(order + "IIII", ts_us // 10**6, ts_us % 10**6 * (1000 if nano else 1), len(frame), len(frame)) + frame
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data[:len(data) - cut] if cut else data)


def test_captures_in_both_orders_with_drop_reasons(spark, tmp_path):
    S = 10**6
    there, back = ipv4("10.0.0.1", "10.0.0.2", 1000, 80), ipv4("10.0.0.2", "10.0.0.1", 80, 1000, size=60)
    frames = [(S, ethernet(there)), (2 * S, ethernet(back, vlan=True)), (3 * S, ethernet(b"", 0x86DD)), (4 * S, ethernet(b"", 0x0806)),
              (5 * S, ethernet(ipv4("1.1.1.1", "2.2.2.2", 1, 2, fragment=5))), (40 * S, ethernet(there)), (6 * S, ethernet(ipv4("9.9.9.9", "8.8.8.8", 0, 0, 1)))]
    capture(tmp_path / "DDoS-SYN" / "a.pcap", frames)
    capture(tmp_path / "Benign" / "b.pcap", frames[:2], ">", nano=True, cut=3)
    capture(tmp_path / "Spoofing" / "c.pcap", [(S, there)], link=101)
    packets = read_captures(spark, str(tmp_path))
    report = {(r.family, r.reason): r.n for r in capture_report(packets).collect()}
    assert report == {("DDoS-SYN", "packets"): 4, ("DDoS-SYN", "ipv6_frames"): 1, ("DDoS-SYN", "non_ip_frames"): 1,
                      ("DDoS-SYN", "fragments_and_malformed"): 1, ("Benign", "packets"): 1, ("Benign", "truncated_final_record"): 1,
                      ("Spoofing", "family_out_of_scope"): 1}
    flows = capture_flows(packets).orderBy("raw_label", "ts", "total_bytes").collect()
    assert [(f.category, f.source_ip, f.total_bytes, f.duration_ms, f.protocol) for f in flows] == [
        ("normal", "10.0.0.1", 40, 0, "tcp"), ("dos", "10.0.0.1", 100, 1000, "tcp"), ("dos", "9.9.9.9", 40, 0, "icmp"), ("dos", "10.0.0.1", 40, 0, "tcp")]
    assert flows[1].features["packets_bwd"] == 1.0 and flows[1].features["packet_rate_hz"] == 2.0


def test_foreign_containers_are_refused(tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + b"\0" * 40)
    with pytest.raises(CaptureError, match="next-generation"):
        list(CaptureReader([]).rows(str(tmp_path / "x.pcap")))
