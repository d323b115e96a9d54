"""End-to-end flows, and the queries registered over the driver's tables."""
