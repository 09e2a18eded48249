"""Tables, change-log sources, snapshots and the wire format."""
