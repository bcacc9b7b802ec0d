"""tidewire.sources."""
