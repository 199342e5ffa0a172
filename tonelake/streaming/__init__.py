"""Live monitoring: frames, meters and gaps of streams of samples."""
