"""Canonical schemas of the input files."""

# Fixed field names of the run history and the journals.
HISTORY = """id STRING, key STRING, repo STRING, lane STRING, configLane STRING, class STRING, weight DOUBLE,
resources STRUCT<cpuCores: DOUBLE, minCpuCores: DOUBLE, memoryBytes: DOUBLE>, command STRING, cmdFingerprint STRING, headTree STRING,
contentKey STRING, contentKeyVerified BOOLEAN, cachedFrom STRING, refusedFrom STRING, executor STRING, runner STRING,
localReason STRING, remoteKind STRING, remotePhase STRING, remoteSignal STRING, exit INT, signal STRING, cancelled BOOLEAN, reason STRING,
error STRING, startedAt DOUBLE, endedAt DOUBLE, queuedAt DOUBLE, waitedMs DOUBLE, runMs DOUBLE, grantedCpuCores DOUBLE, declaredCpuCores DOUBLE,
observedCpu STRUCT<peak: DOUBLE, mean: DOUBLE, samples: INT>, observedRssPeakBytes DOUBLE, cpuSeconds DOUBLE, depsCache STRING,
remotePhasesMs STRUCT<uploadMs: DOUBLE, queuedMs: DOUBLE, snapshotMs: DOUBLE, depsMs: DOUBLE, setupMs: DOUBLE, commandMs: DOUBLE,
artifactsMs: DOUBLE, artifactReturnMs: DOUBLE>, placement STRUCT<runner: STRING, predictedWaitMs: DOUBLE, predictedRunMs: DOUBLE,
tier: STRING, n: INT>, redispatchedFrom ARRAY<STRING>, redispatchReason STRING, event STRING"""
JOURNAL = "at STRING, event STRING, pr BIGINT, prs ARRAY<BIGINT>, runId STRING, laneId STRING"
STORE_JOURNAL = "seq BIGINT, kind STRING, path STRING, sha256 STRING, size BIGINT, createdAt BIGINT"
PR_LIST = "number BIGINT, mergedAt STRING, closedAt STRING, labels ARRAY<STRING>"
