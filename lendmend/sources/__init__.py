"""Landing, zones, relational sync and the message stream."""
