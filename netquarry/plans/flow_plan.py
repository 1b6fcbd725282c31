"""The full flow table: schema, rules and repairs of its 109 columns, ready for quality.repair and quality.typed."""

from __future__ import annotations

from netquarry.operators.quality import TIMESTAMP_TEXT, Numeric, Plan, Rule, Text

COUNT = Numeric(integer=True, allow_nan=False)
MEASURE = Numeric()
LENGTH = Numeric(maximum=65535)
TCP = Numeric(integer=True, allow_negative=True, allow_nan=False, maximum=65535, sentinel=(-1,))
TCP_MEASURE = Numeric(allow_negative=True, maximum=65535, sentinel=(-1,))
TTL = Numeric(integer=True, allow_negative=True, allow_nan=False, maximum=255, sentinel=(-1,))
TTL_MEASURE = Numeric(allow_negative=True, maximum=255, sentinel=(-1,))
RATIO = Numeric(maximum=1)
PAYLOAD = Numeric(integer=True, allow_nan=False, maximum=65535)

# The columns of the flow table, in its order, by what they may hold.
GROUPS = (
    (COUNT, ("Source Port", "Destination Port", "Protocol", "Total Fwd Packets", "Total Bwd Packets", "act_data_pkt_fwd")),
    (COUNT, ("Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Header Length", "Bwd Header Length")),
    (MEASURE, ("Subflow Fwd Packets", "Subflow Bwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Bytes")),
    (MEASURE, ("Flow IAT Mean", "Flow IAT Std", "Fwd IAT Mean", "Fwd IAT Std", "Bwd IAT Mean", "Bwd IAT Std", "Active Mean", "Active Std", "Idle Mean", "Idle Std")),
    (COUNT, ("Flow Duration", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Max", "Bwd IAT Min", "Active Max", "Active Min", "Idle Max", "Idle Min")),
    (LENGTH, ("Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std", "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std")),
    (LENGTH, ("Packet Length Min", "Packet Length Max", "Packet Length Mean", "Packet Length Std")),
    (MEASURE, ("Packet Length Variance", "Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s", "Down/Up Ratio", "dst_port_scan_rate", "src_dst_pair_flow_rate")),
    (TCP, ("Init_Win_bytes_forward", "Init_Win_bytes_backward", "min_seg_size_forward")),
    (COUNT, ("Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count")),
    (MEASURE, ("Fwd Avg Bytes/Bulk", "Bwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Bwd Avg Packets/Bulk", "Fwd Avg Bulk Rate", "Bwd Avg Bulk Rate")),
    (COUNT, ("dst_port_unique_cnt",)),
    (RATIO, ("dst_port_sequentiality",)),
    (MEASURE, ("dst_port_entropy",)),
    (TTL_MEASURE, ("TTL Fwd Mean", "TTL Fwd Std", "TTL Bwd Mean", "TTL Bwd Std")),
    (TTL, ("TTL Fwd Min", "TTL Fwd Max", "TTL Bwd Min", "TTL Bwd Max")),
    (TCP_MEASURE, ("TCP Window Fwd Mean", "TCP Window Fwd Std", "TCP Window Bwd Mean", "TCP Window Bwd Std")),
    (TCP, ("TCP Window Fwd Min", "TCP Window Fwd Max", "TCP Window Bwd Min", "TCP Window Bwd Max")),
    (LENGTH, ("Payload Mean", "Payload Std", "Payload Median", "Payload P25", "Payload P75")),
    (PAYLOAD, ("Payload Min",)),
    (COUNT, ("Retransmission Count",)),
)
# The columns that are dropped first.
DROPPED = (
    "Fragmentation Count", "Fragmentation Offset Mean", "Fragmentation Offset Max", "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Fwd Header Length.1", "Payload Max", "Average Packet Size",
)
TEXTS = {"Flow ID": Text(), "Source IP": Text(), "Destination IP": Text(), "Timestamp": TIMESTAMP_TEXT, "Label": Text()}
SCHEMA = {name: check for check, names in GROUPS for name in names} | TEXTS
# The labels that a valid row may have.
VALID_LABELS = (
    "Benign", "Bot", "Brute Force -Web", "Brute Force -XSS", "DDoS attacks-LOIC-HTTP", "DDoS attacks-HOIC", "DDoS attacks-LOIC-UDP", "DDOS attack-Hulk", "DDOS attack-GoldenEye", "DDOS attack-Slowloris",
    "DDOS attack-SlowHTTPTest", "FTP-BruteForce", "SSH-BruteForce", "Infilteration", "SQL Injection",
)
# The rules. A comparison on a line of its own is read by itself under chain_scope "line".
RULES = (
    Rule("R001", "0 <= Destination Port <= 65535"),
    Rule("R002", "Packet Length Min <= Packet Length Mean <= Packet Length Max"),
    Rule("R003", "Fwd Packet Length Min <= Fwd Packet Length Mean <= Fwd Packet Length Max"),
    Rule("R004", "Bwd Packet Length Min <= Bwd Packet Length Mean <= Bwd Packet Length Max"),
    Rule("R005", "Active Min <= Active Mean <= Active Max"),
    Rule("R006", "Idle Min <= Idle Mean <= Idle Max"),
    Rule("R007", "act_data_pkt_fwd <= Total Fwd Packets"),
    Rule("R008", "Fwd Header Length >= 0 AND Bwd Header Length >= 0"),
    Rule("R009", "Active Max <= Flow Duration AND Idle Max <= Flow Duration"),
    Rule("R010", "Flow IAT Min <= Flow IAT Mean <= Flow IAT Max"),
    Rule("R011", "Fwd IAT Min <= Fwd IAT Mean <= Fwd IAT Max"),
    Rule("R012", "Bwd IAT Min <= Bwd IAT Mean <= Bwd IAT Max"),
    Rule("R014", "Flow Duration > 0"),
    Rule("R015", "Label IN VALID_LABEL_SET", constants={"VALID_LABEL_SET": list(VALID_LABELS)}),
    Rule("R016", "( Total Length of Fwd Packets + Total Length of Bwd Packets ) / ( Flow Duration / 1000000 ) - 0.000001\n<=\nFlow Bytes/s\n<=\n( Total Length of Fwd Packets + Total Length of Bwd Packets ) / ( Flow Duration / 1000000 ) + 0.000001", target="Flow Bytes/s"),
    Rule("R017", "( Total Fwd Packets + Total Bwd Packets ) / ( Flow Duration / 1000000 ) - 0.000001\n<=\nFlow Packets/s\n<=\n( Total Fwd Packets + Total Bwd Packets ) / ( Flow Duration / 1000000 ) + 0.000001", target="Flow Packets/s"),
    Rule("R018", "( Total Fwd Packets ) / ( Flow Duration / 1000000 ) - 0.000001\n<=\nFwd Packets/s\n<=\n( Total Fwd Packets ) / ( Flow Duration / 1000000 ) + 0.000001", target="Fwd Packets/s"),
    Rule("R019", "( Total Bwd Packets ) / ( Flow Duration / 1000000 ) - 0.000001\n<=\nBwd Packets/s\n<=\n( Total Bwd Packets ) / ( Flow Duration / 1000000 ) + 0.000001", target="Bwd Packets/s"),
    Rule("R022", "Total Bwd Packets / Total Fwd Packets - 0.000001\n<=\nDown/Up Ratio\n<=\nTotal Bwd Packets / Total Fwd Packets + 0.000001", target="Down/Up Ratio"),
    Rule("R023", "Packet Length Std ** 2 - 0.000001\n<=\nPacket Length Variance\n<=\nPacket Length Std ** 2 + 0.000001", target="Packet Length Variance"),
    Rule("R025", "TCP Window Fwd Mean == -1 OR TCP Window Fwd Mean >= 0", target="TCP Window Fwd Mean"),
    Rule("R026", "TCP Window Fwd Std == -1 OR TCP Window Fwd Std >= 0", target="TCP Window Fwd Std"),
    Rule("R027", "TCP Window Fwd Min == -1 OR TCP Window Fwd Min >= 0", target="TCP Window Fwd Min"),
    Rule("R028", "TCP Window Fwd Max == -1 OR TCP Window Fwd Max >= 0", target="TCP Window Fwd Max"),
    Rule("R029", "TCP Window Bwd Mean == -1 OR TCP Window Bwd Mean >= 0", target="TCP Window Bwd Mean"),
    Rule("R030", "TCP Window Bwd Std == -1 OR TCP Window Bwd Std >= 0", target="TCP Window Bwd Std"),
    Rule("R031", "TCP Window Bwd Min == -1 OR TCP Window Bwd Min >= 0", target="TCP Window Bwd Min"),
    Rule("R032", "TCP Window Bwd Max == -1 OR TCP Window Bwd Max >= 0", target="TCP Window Bwd Max"),
    Rule("R033", "Payload Min != -1", target="Payload Min"),
    Rule("R034", "Payload P25 != -1", target="Payload P25"),
    Rule("G001", "TCP Window Fwd Mean != -1", target="TCP Window Fwd Mean", applies="Protocol != 6 OR Total Fwd Packets == 0"),
    Rule("G002", "TCP Window Fwd Std != -1", target="TCP Window Fwd Std", applies="Protocol != 6 OR Total Fwd Packets == 0"),
    Rule("G003", "TCP Window Fwd Min != -1", target="TCP Window Fwd Min", applies="Protocol != 6 OR Total Fwd Packets == 0"),
    Rule("G004", "TCP Window Fwd Max != -1", target="TCP Window Fwd Max", applies="Protocol != 6 OR Total Fwd Packets == 0"),
    Rule("G005", "TCP Window Bwd Mean != -1", target="TCP Window Bwd Mean", applies="Protocol != 6 OR Total Bwd Packets == 0"),
    Rule("G006", "TCP Window Bwd Std != -1", target="TCP Window Bwd Std", applies="Protocol != 6 OR Total Bwd Packets == 0"),
    Rule("G007", "TCP Window Bwd Min != -1", target="TCP Window Bwd Min", applies="Protocol != 6 OR Total Bwd Packets == 0"),
    Rule("G008", "TCP Window Bwd Max != -1", target="TCP Window Bwd Max", applies="Protocol != 6 OR Total Bwd Packets == 0"),
    Rule("G009", "TTL Fwd Mean != -1", target="TTL Fwd Mean", applies="Total Fwd Packets == 0"),
    Rule("G010", "TTL Fwd Std != -1", target="TTL Fwd Std", applies="Total Fwd Packets == 0"),
    Rule("G011", "TTL Fwd Min != -1", target="TTL Fwd Min", applies="Total Fwd Packets == 0"),
    Rule("G012", "TTL Fwd Max != -1", target="TTL Fwd Max", applies="Total Fwd Packets == 0"),
    Rule("G013", "TTL Bwd Mean != -1", target="TTL Bwd Mean", applies="Total Bwd Packets == 0"),
    Rule("G014", "TTL Bwd Std != -1", target="TTL Bwd Std", applies="Total Bwd Packets == 0"),
    Rule("G015", "TTL Bwd Min != -1", target="TTL Bwd Min", applies="Total Bwd Packets == 0"),
    Rule("G016", "TTL Bwd Max != -1", target="TTL Bwd Max", applies="Total Bwd Packets == 0"),
)
# What a repair writes, in this order.
FORMULAS = {
    "Flow Bytes/s": "( Total Length of Fwd Packets + Total Length of Bwd Packets ) / ( Flow Duration / 1000000 )",
    "Flow Packets/s": "( Total Fwd Packets + Total Bwd Packets ) / ( Flow Duration / 1000000 )",
    "Fwd Packets/s": "( Total Fwd Packets ) / ( Flow Duration / 1000000 )",
    "Bwd Packets/s": "( Total Bwd Packets ) / ( Flow Duration / 1000000 )",
    "Down/Up Ratio": "Total Bwd Packets / Total Fwd Packets",
    "Packet Length Variance": "Packet Length Std ** 2",
    "TCP Window Fwd Mean": "TCP Window Fwd Mean + 65536",
    "TCP Window Fwd Std": "TCP Window Fwd Std + 65536",
    "TCP Window Fwd Min": "TCP Window Fwd Min + 65536",
    "TCP Window Fwd Max": "TCP Window Fwd Max + 65536",
    "TCP Window Bwd Mean": "TCP Window Bwd Mean + 65536",
    "TCP Window Bwd Std": "TCP Window Bwd Std + 65536",
    "TCP Window Bwd Min": "TCP Window Bwd Min + 65536",
    "TCP Window Bwd Max": "TCP Window Bwd Max + 65536",
    "Payload Min": "Payload Min * 0",
    "Payload P25": "Payload P25 * 0",
}
# The rules whose violation a formula mends.
REPAIRABLE_RULES = frozenset({
    "R016", "R017", "R018", "R019", "R022", "R023", "R025", "R026", "R027", "R028", "R029", "R030", "R031", "R032", "R033", "R034",
})
# Columns that never make a row invalid.
IGNORED = frozenset({"Source Port", "Flow ID", "Source IP", "Destination IP"})


def flow_plan(chain_scope: str = "line") -> Plan:
    """The plan for the whole flow table. chain_scope "expression" reads the tolerance rules as they are meant."""
    return Plan(SCHEMA, RULES, FORMULAS, REPAIRABLE_RULES, frozenset(SCHEMA) - frozenset(FORMULAS) - IGNORED, chain_scope)
