"""Sources and sinks: landed files, the lander, the message stream."""
