"""Sources and sinks: table readers, config readers, the prediction-log sink."""
