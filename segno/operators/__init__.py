"""DataFrame operators over note events and the timelines around them."""
