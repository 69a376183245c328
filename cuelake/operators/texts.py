"""What each finding means, by its code."""

DETAILS = {
    "AD_CONTAINER_MISMATCH": "The segments of the break are of another container than those around it, which few players change between.",
    "AVAIL_NOT_STITCHED": "The feed signals an avail here, and the output shows no break for it: the slot was not sold or not inserted.",
    "AVAIL_OVER_FILLED": "What was stitched is longer than the avail, so that programme is lost behind it.",
    "AVAIL_PASSED_THROUGH": "The output has a break here with the feed's own media: nothing was inserted.",
    "AVAIL_UNDER_FILLED": "What was stitched is shorter than the avail; the rest shows slate or black.",
    "AV_DURATION_SKEW": "Audio and video of the period differ in length; the difference adds up over periods.",
    "BREAK_IN_PROGRESS": "The break is still open at the live edge, and not longer than it should be.",
    "BREAK_OVERRUN": "The break lasts longer than its signal says.",
    "BREAK_OVERRUN_UNCLOSED": "The break is well beyond its signalled length and nothing has ended it.",
    "BREAK_UNDERRUN": "The break ends before its signal says.",
    "DATERANGE_DUPLICATE_ID": "Several date ranges share an ID without being parts of one range.",
    "DATERANGE_START_DATE_MISMATCH": "The date range starts at another time than the segment it stands at.",
    "DUAL_SIGNALLING": "One splice is signalled by several kinds of tags.",
    "DUPLICATE_EVENT_STREAMS": "The same events are repeated in several event streams; each counts once.",
    "DUPLICATE_PERIOD_ID": "Several periods have the same id, so players can't tell them apart on a reload.",
    "DYNAMIC_NO_AST": "A live manifest has no availabilityStartTime, so that players can't tell which segments exist.",
    "DYNAMIC_NO_MUP": "A live manifest has no minimumUpdatePeriod, so that players never load it again.",
    "EMPTY_PERIOD": "The period has neither media nor a reference to any.",
    "EVENT_AMBIGUOUS_TIME": "Several events state no presentation time; all of them are taken to be at the period's start.",
    "EVENT_ID_REUSED": "Several breaks share an event id; systems that join on it will mix them up.",
    "EVENT_MISSING_ID": "Events of a live manifest have no id, so that a reload can't be told from a new event.",
    "INBAND_EVENT_STREAM_DECLARED": "The manifest announces splice messages inside the segments.",
    "INBAND_MANIFEST_EVENT_ID_MISMATCH": "The cue in the segment and the manifest's break have different event ids.",
    "INBAND_MANIFEST_TIME_MISMATCH": "The cue in the segment means another time than the manifest's break.",
    "INBAND_ONLY_SIGNALLING": "The segments carry a cue, and the manifest has no breaks.",
    "INBAND_SCTE35_CRC_INVALID": "A cue in a segment fails its checksum.",
    "INBAND_SCTE35_UNDECODABLE": "A cue in a segment can't be decoded.",
    "INBAND_SIGNAL_NOT_IN_MANIFEST": "A cue in a segment has no break of the manifest near it.",
    "INTERSTITIAL_AMBIGUOUS_ASSET": "The interstitial names both an asset and a list of assets.",
    "INTERSTITIAL_NO_ASSET": "The interstitial names neither an asset nor a list of assets.",
    "INTERSTITIAL_OVERLAP": "The interstitial starts before the one ahead of it ends.",
    "INTERSTITIAL_PRE_AND_POST": "The interstitial is to play both before and after the programme.",
    "INTERSTITIAL_SIGNALLING": "Ads are placed by interstitials, which the player resolves.",
    "INTERSTITIAL_UNBOUNDED": "Neither a duration nor a limit tells how long the interstitial may last.",
    "INTERSTITIAL_UNKNOWN_ATTRIBUTE_VALUE": "An attribute of the interstitial has a value that players don't know.",
    "LL_AD_DECISION_BUDGET": "At low latency, little time is left between a cue and the ad decision.",
    "LL_DASH_DELAY_DISAGREEMENT": "The suggested delay and the latency target differ.",
    "LL_DASH_EARLY_AVAILABILITY_WITHOUT_CHUNKING": "Segments are announced early without being made in chunks.",
    "LL_DASH_NO_LATENCY_TARGET": "Segments come in chunks, and no latency target says what for.",
    "LL_DASH_TARGET_UNREACHABLE": "The latency target is shorter than a segment, which only chunks can meet.",
    "LL_DELTA_UPDATE_DROPS_DATERANGES": "Delta updates leave out date ranges, and with them cues.",
    "LL_NO_BLOCKING_RELOAD": "A low-latency playlist can't be reloaded as soon as it changes.",
    "LL_NO_PRELOAD_HINT": "A low-latency playlist does not name the next part ahead.",
    "LL_NO_RENDITION_REPORT": "A low-latency playlist does not tell where the other renditions are.",
    "LL_NO_SERVER_CONTROL": "A low-latency playlist does not say what its server can do.",
    "LL_PART_HOLD_BACK_TOO_SMALL": "The hold-back is under three parts, so players will stall.",
    "MAP_CHANGED_WITHOUT_DISCONTINUITY": "The initialisation map changes at the break without a discontinuity.",
    "MUP_LONGER_THAN_SHORTEST_BREAK": "Players reload less often than the shortest break lasts, and may miss it.",
    "NESTED_CUE_OUT": "A break opens while another one is open.",
    "NO_ASSET_IDENTIFIER": "Periods don't say which asset they belong to.",
    "NO_AUTO_RETURN_NO_CUE_IN": "The break neither ends by itself nor is ended by a cue.",
    "NO_COMMON_CLOCK": "Feed and output have no wall-clock time in common and can't be compared.",
    "NO_COMMON_WINDOW": "The renditions' windows do not overlap, so that breaks can't be compared.",
    "NO_DISCONTINUITY_AT_BREAK_END": "Media changes back at the end of the break without a discontinuity.",
    "NO_DISCONTINUITY_AT_BREAK_START": "Media changes at the start of the break without a discontinuity.",
    "NO_INBAND_SCTE35": "The manifest has breaks, and the segments that were opened carry no cue.",
    "NO_OVERLAPPING_WINDOW": "The windows of feed and output do not overlap.",
    "NO_PERIODS": "The manifest has no period.",
    "NO_PERIOD_CONTINUITY_SIGNAL": "Periods of the same structure don't say whether they continue each other.",
    "NO_PROGRAM_DATE_TIME": "Without wall-clock times breaks can't be matched with other systems.",
    "NO_VARIANT_READABLE": "None of the variants could be read.",
    "ORPHAN_BREAK_END": "A break ends that never began.",
    "ORPHAN_CUE_IN": "A return to programme without a departure before it.",
    "PDT_DISCONTINUITY": "The wall clock jumps between two segments.",
    "PERIOD_MEDIA_STARTS_LATE": "The media of the period begins after the period does.",
    "PERIOD_MISSING_ID": "The period has no id, so players can't follow it over reloads.",
    "PERIOD_TIMELINE_GAP": "Nothing plays between the end of this period and the start of the next one.",
    "PERIOD_TIMELINE_OVERLAP": "This period's media reaches into the next one.",
    "PERIOD_TRIMMED_AT_WINDOW": "The front of the period has left the live window.",
    "PTO_MISMATCH": "The presentation time offset does not place the media at the period's start.",
    "REPRESENTATION_SET_CHANGED": "The next period offers other representations, so decoders must be set up again.",
    "S104_AVAIL_NUMBERING": "The request's avail number is beyond the number of avails it expects.",
    "S104_DIRECTION_CHANGED": "The encoder turned the request's direction round.",
    "S104_DURATION_CHANGED": "The encoder emitted another length than was requested.",
    "S104_EVENT_ID_CHANGED": "The encoder emitted another event id than was requested.",
    "S104_FORM_CHANGED": "A splice request came out as a segmentation descriptor.",
    "S104_IMMEDIATE_SPLICE": "The request leaves no time to prepare the splice.",
    "S104_NOTHING_TO_COMPARE": "The message holds no splice or segmentation request.",
    "S104_NO_AUTO_RETURN": "The request states a length and does not ask for a return.",
    "S104_NO_BREAK_DURATION": "The request states no length.",
    "S104_NO_OPERATIONS": "The message holds no operations.",
    "S104_NO_SPLICE_EMITTED": "The request had no splice as its result.",
    "S104_SEGMENTATION_EVENT_ID_CHANGED": "The encoder emitted another segmentation event id than was requested.",
    "S104_SEGMENTATION_TYPE_CHANGED": "The encoder emitted another segmentation type than was requested.",
    "S104_SHORT_PRE_ROLL": "The pre-roll is too short for equipment downstream.",
    "S104_UNKNOWN_OPERATION": "The message holds an operation that is not known.",
    "SCTE224_DURATION_MISMATCH": "The policy expects another length than is signalled.",
    "SCTE224_MATCH_DRIFT": "The policy's point matches a break some seconds away.",
    "SCTE224_POINT_EXPIRED": "The policy's point is past its expiry.",
    "SCTE224_POINT_FUTURE": "The policy's point is not in force yet.",
    "SCTE224_POINT_NO_POLICY": "The point neither applies nor removes a policy.",
    "SCTE224_POINT_UNMATCHED": "No break was found for the policy's point.",
    "SCTE224_SIGNAL_NOT_GOVERNED": "The stream has breaks that no point of the policy governs.",
    "SCTE224_SIGNAL_UNDECODABLE": "The signal of the policy's point can't be decoded.",
    "SCTE224_TYPE_MISMATCH": "The policy expects another segmentation type than is signalled.",
    "SCTE35_CRC_INVALID": "The splice section fails its checksum; strict receivers drop it.",
    "SCTE35_DECODE_FAILED": "The splice section can't be decoded.",
    "SCTE35_ENCRYPTED": "The splice section is encrypted, and only its head can be read.",
    "SEGMENTS_NOT_ADDRESSABLE": "No segment of the document has an address that could be opened.",
    "SIGNALLING_ONLY_STREAM": "Breaks are signalled and the media never changes: a feed ahead of ad insertion.",
    "SIGNAL_DURATION_DISAGREEMENT": "The tag and the splice section state different lengths.",
    "SIGNAL_PASSED_THROUGH": "The output still carries the feed's splice signals.",
    "SPLICE_IMMEDIATE": "The splice is to happen at once, without notice.",
    "STITCH_MISALIGNED": "The output's break begins beside the avail that was signalled.",
    "STITCH_NOT_MARKED": "The output's break begins without a discontinuity.",
    "TARGETDURATION_EXCEEDED": "A segment is longer than the playlist allows.",
    "UNCLOSED_BREAK": "Nothing ends the break.",
    "UNPAIRED_SEGMENTATION_TYPE": "A segmentation start has no end of its type.",
    "UNSIGNALLED_AVAIL_IN_OUTPUT": "The output has a break that the feed never signalled.",
    "UPID_EMPTY": "The identifier has a type and no content.",
    "UPID_MALFORMED_ADID": "The identifier is not of the form of an Ad-ID.",
    "UPID_MALFORMED_URI": "The identifier is not a URI.",
    "UPID_MID_EMPTY": "The list of identifiers is empty.",
    "UPID_MID_TRUNCATED": "The list of identifiers ends inside one of them.",
    "UPID_MPU_NO_PRIVATE_DATA": "The private identifier holds nothing behind its format.",
    "UPID_TYPE_NOT_USED": "The descriptor says that no identifier is used.",
    "UPID_WRONG_LENGTH": "The identifier has not the length of its type.",
    "VARIANTS_NOT_ANALYSED": "The master playlist names more variants than were asked to be analysed.",
    "VARIANT_BREAK_COUNT_MISMATCH": "Renditions have different numbers of breaks.",
    "VARIANT_BREAK_MISALIGNED": "The break begins at another time in another rendition.",
    "VARIANT_DURATION_MISMATCH": "The break has another length in another rendition.",
    "VARIANT_FETCH_FAILED": "A variant could not be read, and is left out of the comparison.",
    "VARIANT_MISSING_BREAK": "Another rendition has no break near this one.",
    "VARIANT_SIGNALLING_STYLE_MISMATCH": "Renditions signal breaks by different tags.",
    "VAST_BITRATE_ABOVE_LADDER": "All media files are of a higher rate than the stream's.",
    "VAST_CHAIN_SLOW": "Following the wrappers takes longer than an ad decision may.",
    "VAST_CODEC_MISMATCH": "No media file is of a codec that the stream uses.",
    "VAST_EXECUTABLE_CREATIVE": "The creative is code, which can't be stitched.",
    "VAST_INCOMPLETE_TRACKING": "Some of the events that tell how far an ad was played are not tracked.",
    "VAST_NO_DURATION": "The ad states no length.",
    "VAST_NO_ERROR_URL": "Errors of the ad can't be reported.",
    "VAST_NO_FILL": "The response holds no ad.",
    "VAST_NO_IMPRESSION": "The ad can't be counted.",
    "VAST_NO_MEDIA_FILE": "The ad has no media file.",
    "VAST_NO_STITCHABLE_MEDIA": "No media file of the ad is of a kind that can be stitched.",
    "VAST_NO_TRACKING": "Nothing tells how far the ad was played.",
    "VAST_POD_OVERRUNS_AVAIL": "The ads together are longer than the avail.",
    "VAST_POD_UNDERFILLS_AVAIL": "The ads together are shorter than the avail.",
    "VAST_WRAPPER_LOOP": "A wrapper leads back to an address that was followed already.",
    "VAST_WRAPPER_NO_URI": "A wrapper names no address.",
    "VAST_WRAPPER_TOO_DEEP": "There are more wrappers in a row than are followed.",
    "VAST_WRAPPER_UNPARSEABLE": "What a wrapper leads to is no response.",
    "VAST_WRAPPER_UNRESOLVED": "What a wrapper leads to could not be read.",
    "VMAP_DUPLICATE_OFFSET": "Several breaks of the schedule are at one time.",
    "VMAP_NO_AD_SOURCE": "A break of the schedule names no source of ads.",
    "VMAP_NO_BREAKS": "The schedule holds no breaks.",
    "VMAP_NO_TIME_OFFSET": "A break of the schedule has no time.",
    "XLINK_CODEC_MISMATCH": "The remote period's codecs are none that the programme uses.",
    "XLINK_DURATION_MISMATCH": "The remote period is not as long as its slot.",
    "XLINK_NOT_RESOLVED": "The manifest has more remote periods than were asked to be resolved.",
    "XLINK_NO_ACTUATE": "The remote period does not say when to load it.",
    "XLINK_NO_DURATION": "The remote period has no length until it is loaded.",
    "XLINK_ONLOAD_ON_LIVE": "The remote period of a live manifest is loaded anew at each reload.",
    "XLINK_REMOTE_PERIOD": "The period's content is elsewhere.",
    "XLINK_RESOLVED_EMPTY": "The remote period's address gives no period.",
    "XLINK_RESOLVE_FAILED": "The remote period could not be read.",
    "XLINK_RESOLVE_SLOW": "The remote period's address answers late.",
    "XLINK_RESOLVE_UNPARSEABLE": "The remote period's address gives something else than a period.",
}
