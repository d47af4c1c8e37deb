from hydrosift.functions.wqi import (  # noqa: F401
    alert_gw, alert_sw, bis_wqi, hotspot, mcc_norm, nsf_wqi, priority_gw,
    priority_sw, risk_gw, risk_sw, wqi_class_gw, wqi_class_gw4, wqi_class_sw,
)
from hydrosift.functions.text import dms_to_decimal, short_site, site_tokens  # noqa: F401
