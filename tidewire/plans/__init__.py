"""tidewire.plans."""
