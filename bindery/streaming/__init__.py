"""The map-only pack steps on a stream of documents."""
