"""tracelake: relationship-heavy analytics as ordinary Spark plans."""
