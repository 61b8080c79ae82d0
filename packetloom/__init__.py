"""packetloom: packet-traffic analytics and intrusion detection as Spark DataFrame operators."""

__version__ = "0.1.0"
