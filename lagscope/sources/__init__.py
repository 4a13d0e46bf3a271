"""Sources (raw measurement/price files, star-schema adapters) and sinks."""
